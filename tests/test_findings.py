"""What a reviewer found on odd rows and larger tables."""

import random

import duckdb
import numpy as np

from quillmere.operators import graph, knowledge
from quillmere.plans import catalog
from quillmere.sources import staging


def agrees(spark, folder, name, **tables):
    """Whether a query equals its SQL on the given tables (columns and rows)."""
    connection = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    frame = catalog.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    rows = lambda found: sorted(tuple(str(v) for v in r) for r in found)
    wanted = connection.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert wanted
    assert rows(frame.select(*columns).collect()) == rows(wanted)
    return True


def test_file_size_labels_of_large_keys(spark, tmp_path):
    assert agrees(spark, tmp_path, "file_size_labels", customer=("c_custkey long", [(k,) for k in (1, 8, 100, 700, 7900, 8000, 90_000, 900_000)]))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_wiki_synced_of_short_pages(spark, tmp_path):
    texts = ["tiny", "", None, "\n\t ", "long enough by far", " short  ", "123456789", "1234567890", "\n234567890\n"]
    rows = [(4 * i + j, t, "en", "web", len(t or "")) for i, t in enumerate(texts) for j in range(4)]
    assert agrees(spark, tmp_path, "wiki_synced", documents=(DOCS, rows))


def written_frames(monkeypatch):
    """What staging.written() writes from now on, by name, with its plan and rows."""
    found, write = [], staging.written

    def recorded(frame, name):
        out = write(frame, name)
        found.append((name, frame._jdf.queryExecution().toString(), out.count()))
        return out

    monkeypatch.setattr(staging, "written", recorded)
    return found


def test_closure_writes_each_pair_once(spark, monkeypatch):
    seen = written_frames(monkeypatch)
    pairs = graph.closure(spark.createDataFrame([(i // 2, i) for i in range(2, 128)], "source long, target long")).count()
    assert sum(n for name, _, n in seen if name == "closure") <= pairs


def test_layers_go_by_no_broadcast(spark, monkeypatch):
    seen = written_frames(monkeypatch)
    found = graph.layers(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "source long, target long"))
    assert {r.node: r.layer for r in found.collect()} == {1: 0, 2: 1, 3: 2}
    assert not any("Broadcast" in plan for _, plan, _ in seen)


def test_signatures_are_computed_once(spark):
    frame = catalog.queries()["signature_jaccard"](spark, "/root/testdata/sf0.001")
    assert frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


def test_merge_candidates_goes_by_no_shuffle(spark):
    frame = catalog.queries()["merge_candidates"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_code_chunks_takes_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalog.queries()["code_chunks"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "256"


def test_fuzzy_reconcile_of_titles_that_share_words(spark, tmp_path, monkeypatch):
    some = random.Random(3)
    titles = [" ".join(some.choices([f"word{i}" for i in range(9)], k=some.randint(1, 7))) for _ in range(200)]
    rows = [(i, f"{t}\nbody {i % 3}", some.choice(["en", "de"]), "web", 0) for i, t in enumerate(titles)]
    # A type that is null or ends with words of another's titles is a type of its own.
    rows += [(1000, "zebra quagga", "en", "web", 0), (1001, "en zebra quagga", None, "web", 0), (1003, "quagga", "en zebra", "web", 0), (1005, "", "en", "web", 0), (1007, None, "en", "web", 0)]
    seen = written_frames(monkeypatch)
    assert agrees(spark, tmp_path, "fuzzy_reconcile", documents=(DOCS, rows))
    assert max(n for _, _, n in seen) <= len(rows) and any("FlatMapCoGroupsInArrow" in plan for _, plan, _ in seen)


def test_first_like_equals_brute_force(monkeypatch):
    monkeypatch.setattr(knowledge, "HITS", 8)
    some = np.random.default_rng(5)

    def titles(n):
        sets = [np.sort(some.choice(12, some.integers(1, 9), replace=False)) for _ in range(n)]
        return sets, knowledge._Titles(np.concatenate(sets), np.array([len(x) for x in sets]), 12)

    def like(a, b):
        common, least = len(np.intersect1d(a, b)), min(len(a), len(b))
        return (common / (len(a) + len(b) - common) if least < 2 else common / least) >= 0.6

    (new, a), (old, b) = titles(60), titles(50)
    assert knowledge._first_like(a, b, 0.6).tolist() == [next((j for j, y in enumerate(old) if like(x, y)), len(old)) for x in new]


def test_near_dups_writes_sets_of_candidates_alone(spark, tmp_path, monkeypatch):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    texts = [words(0, 40), words(0, 40) + " more", words(1, 30), words(2, 30), "", None, words(0, 40)]
    seen = written_frames(monkeypatch)
    assert agrees(spark, tmp_path, "near_dups", documents=(DOCS, [(i, t, "en", "web", 0) for i, t in enumerate(texts) if t]))
    written = {name: (plan, n) for name, plan, n in seen}
    assert written["hashed"][1] == 4 and written["sets"][1] == 2
