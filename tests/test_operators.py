import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions import strings
from quillmere.operators import forecast, graph, ingestion, knowledge, ledger, people, retrieval, text
from quillmere.sources import stores


def one(spark, column, **values):
    frame = spark.range(1)
    for k, v in values.items():
        frame = frame.withColumn(k, F.lit(v))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given_", "wanted"), [("0peration", "Operation"), ("l am", "I am"), ("arnount", "amount"), ("rea1ly", "really"), ("1,234", "1234"), ("a|b", "aIb")])
def test_ocr(spark, given_, wanted):
    assert one(spark, text.ocr_repair(F.col("t")), t=given_) == wanted


def test_nfc_and_clean(spark):
    assert one(spark, text.nfc(F.col("t")), t="é") == "é"
    assert one(spark, text.surface_clean(F.col("t")), t=" a\x07b  c­\n\n\n\nd ") == "a b c\n\nd"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;\n?!", max_size=600), st.integers(5, 60))
def test_split_keeps_the_text(t, limit):
    parts = text.split_text(t, limit)
    assert all(len(p) <= limit for p in parts)
    assert "".join(parts).split() == t.split() or "".join("".join(parts).split()) == "".join(t.split())


def test_chunks_overlap_and_ids(spark):
    import uuid

    words = " ".join(f"word{i}" for i in range(1500))
    rows = text.chunks(spark.createDataFrame([(1, words), (2, "short text here."), (3, None), (4, "")], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r.doc_id == 1]
    assert first[1].text.startswith(first[0].text[-text.OVERLAP_CHARS :] + "\n...\n") and first[0].total_chunks == len(first)
    assert all(r.chunk_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.doc_id}:{r.chunk_index}")) for r in rows) and {r.doc_id for r in rows} == {1, 2}


spans = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 30), st.integers(1, 8), st.sampled_from("AB"), st.integers(0, 3)), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(spans)
def test_merged_spans_cover_the_same(spark, rows):
    frame = spark.createDataFrame([(d, s, s + n, k, c) for d, s, n, k, c in rows], "doc_id int, start int, end int, kind string, score int")
    found = text.merged_spans(frame).collect()
    covered = lambda xs: {(d, i) for d, a, b in xs for i in range(a, b)}
    assert covered((r.doc_id, r.start, r.end) for r in found) == covered((d, s, s + n) for d, s, n, _, _ in rows)
    for doc in (0, 1):
        own = sorted((r.start, r.end) for r in found if r.doc_id == doc)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_secrets(spark):
    docs = spark.createDataFrame([(1, "password: hunter2\nBearer abcdefghij.k"), (2, None)], "doc_id long, text string")
    assert {(r.kind, r.value) for r in text.secrets(docs).collect()} == {("SECRET_VALUE", "password: hunter2"), ("API_KEY", "Bearer abcdefghij.k")}
    assert one(spark, text.masked(F.col("t")), t="x token=abc y") == "x [SECRET_VALUE] y"


def test_lexical_boost(spark):
    boost = retrieval.lexical_boost(["coding", "best", "practises", "review"], F.col("t"))
    assert one(spark, boost, t="# Coding Best Practices\n\nbody") == pytest.approx(0.375)
    assert one(spark, F.array_join(retrieval.query_terms(F.col("q")), " "), q="What decisions were made on coding best practises?") == "decisions coding best practises"


def test_source_caps(spark):
    docs = [(i, f"mail {i}", 0.9, "gmail") for i in range(10)] + [(100 + i, f"page {i}", 0.5, "notion") for i in range(6)]
    found = retrieval.ranked(spark.createDataFrame(docs, "doc int, text string, best_score double, source string"), [], 5, 8, {"gmail": 2}).collect()
    assert sum(r.source == "gmail" for r in found) == 2 and len(found) == 7


def test_regroup(spark):
    chunks = [("d1", 1, "notion", 0.4, "beta"), ("d1", 0, "notion", 0.9, "alpha"), ("d1", 2, "notion", 0.1, "alpha "), (None, 0, "x", 1.0, "lost")]
    r = retrieval.regrouped(spark.createDataFrame(chunks, "doc string, chunk_index int, source string, score double, text string")).collect()
    assert [(x.doc, x.text, x.best_score, x.best_chunk) for x in r] == [("d1", "alpha\n\nbeta", 0.9, 0)]


def test_ledger_window_refund_and_idempotency(spark):
    at = lambda d: dt.datetime(2026, 8, d)
    usage = spark.createDataFrame([(1, 5.0, at(1), "a"), (1, -2.0, at(31), "b"), (1, 9.0, dt.datetime(2026, 9, 1), "c")], "tenant_id int, c double, occurred_at timestamp_ntz, idempotency_key string")
    usage = usage.withColumn("credits", F.col("c").cast("decimal(20,6)")).withColumn("quantity", F.col("c").cast("decimal(20,6)"))
    credits = spark.createDataFrame([(1, 10.0, at(1))], "tenant_id int, c double, created_at timestamp_ntz").withColumn("credits", F.col("c").cast("decimal(20,6)"))
    assert float(ledger.balances(usage, credits, "2026-08-01", "2026-09-01").first().balance) == 7.0
    assert {r.idempotency_key for r in ledger.idempotent(usage.unionByName(usage), usage.where("idempotency_key = 'a'")).collect()} == {"c"}


def test_half_up(spark):
    assert one(spark, ledger.half_up(F.col("x"), 0), x=-2.5) == -2.0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (4, 4)], "source int, target int")
    assert {(r.node, r.upstream) for r in graph.closure(edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    asked = spark.createDataFrame([(5, 5), (1, 2), (3, 2), (5, 1)], "source int, target int")
    assert {(r.source, r.target): r.reason for r in graph.link_refusals(asked, edges).collect()} == {(5, 5): "self", (1, 2): "duplicate", (3, 2): "cycle", (5, 1): None}
    chain = spark.createDataFrame([(i, i + 1 if i < 9 else None) for i in range(10)], "id int, superseded_by int")
    assert {(r.head, r.steps) for r in graph.heads(chain).where("id = 0").collect()} == {(9, 9)}


def test_reconcile(spark):
    known = spark.createDataFrame([(1, "decision", "Q3 budget", "we keep the whole budget for travel", 0)], "id int, type string, title string, body string, recency int")
    new = spark.createDataFrame([(7, "decision", "The Q3 Budget", "we keep the whole budget for travel"), (8, "decision", "Q3 budget", "cut everything completely now"), (9, "note", "Q3 budget", "x")], "id int, type string, title string, body string")
    assert {r.id: r.action for r in knowledge.reconcile(new, known).collect()} == {7: "skip", 8: "update", 9: "create"}


def test_merge_candidates(spark):
    rows = [(1, i, "note", f"budget plan {i % 2}", c) for i, c in enumerate((0.2, 0.9, 0.5))] + [(1, 9, "fact", "budget plan 0", 0.1)]
    found = knowledge.merged_candidates(spark.createDataFrame(rows, "doc_id int, id int, type string, title string, confidence double")).collect()
    assert sorted(r.id for r in found) == [1, 9]


def test_times_and_authors(spark):
    assert one(spark, ingestion.parsed_time(F.col("t")).cast("string"), t="1700000000") == "2023-11-14 22:13:20"
    assert one(spark, ingestion.parsed_time(F.col("t")).cast("string"), t="1700000000000") == "2023-11-14 22:13:20"
    assert one(spark, ingestion.parsed_time(F.col("t")), t="nonsense") is None
    assert one(spark, ingestion.author(F.col("t")), t="  ") == "Unknown"
    assert one(spark, strings.owner_names(F.col("t")), t="x\nOwner: Miss Moreau, JANE DOE and a@b.c") == ["Miss Moreau", "JANE DOE"]


def test_tenant_isolation(spark, tmp_path):
    own = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    with pytest.raises(stores.ForeignTenant):
        stores.write_features(own, str(tmp_path), "a")
    stores.write_features(stores.scoped(own, "a"), str(tmp_path), "a")
    assert stores.read_features(spark, str(tmp_path), "a").count() == 1
    with pytest.raises(ValueError):
        stores.tenant("no/slash")
    objects = spark.createDataFrame([("a", b"x"), ("a", b"x"), ("b", b"x")], "tenant_id string, content binary")
    assert stores.new_objects(objects, stores.object_keys(objects.where("tenant_id = 'b'"))).count() == 1


def test_near_duplicates_beyond_a_buckets_first(spark, monkeypatch):
    import random
    from itertools import combinations

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def edited(n):
        words = list(base)
        for i in rng.sample(range(400), n):
            words[i] = f"e{rng.randrange(10**6)}"
        return " ".join(words)

    # The smallest document is under .85 to most others, though it shares buckets with them; others are alike.
    rows = [(0, edited(30)), *((i, edited(rng.choice((2, 6, 12, 22)))) for i in range(1, 40)), (40, " ".join(base)), (41, " ".join(base)), (42, "other words"), (43, "other words")]
    monkeypatch.setattr(text, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = {}
    for r in text.lsh_buckets(text.minhash(docs.select("doc_id", F.transform(text.shingles(F.col("text")), text.shingle_hash).alias("h")))).collect():
        buckets.setdefault((r.band, r.bucket), []).append(r.doc_id)
    met = {p for ids in buckets.values() for p in combinations(sorted(ids), 2)}
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))} for d, t in rows}
    wanted = {d: d for d in sets}
    linked = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    first = {}
    for ids in buckets.values():
        for d in ids:
            first.setdefault(d, set()).add(min(ids))
    found = {r.doc_id: r.canonical for r in text.near_duplicates(docs).collect()}
    assert found == wanted
    assert any(wanted[d] != d and wanted[d] not in first[d] for d in sets)  # comparisons with the first alone would miss these


def test_layers_of_full_graphs_and_cycles(spark):
    """Each edge is gone through once, though there are 8 ** 8 paths."""
    from quillmere.operators import graph

    edges = [(8 * k + i, 8 * (k + 1) + j) for k in range(7) for i in range(8) for j in range(8)] + [(0, 63)]
    found = {r.node: r.layer for r in graph.layers(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert found == {n: n // 8 for n in range(64)}
    with pytest.raises(ValueError):
        graph.layers(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "source long, target long"))
    assert graph.layers(spark.createDataFrame([], "source long, target long")).count() == 0


def test_components_and_heads(spark):
    from quillmere.operators import graph

    edges = [(i + 1, i) for i in range(20)] + [(100, x) for x in range(101, 120)] + [(120, 119), (7, 7)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 100 if i < 119 else 100 for i in range(100, 120)} | {120: 100}
    versions = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 9)], "id long, superseded_by long")
    assert {(r.id, r.head, r.steps) for r in graph.heads(versions).collect()} == {(1, 3, 2), (2, 3, 1), (3, 3, 0), (4, 9, 1)}


def test_ledger_takes_finite_quantities_once(spark):
    from quillmere.operators import ledger

    rows = [("a", 1.0, "x"), ("a", 1.0, "w"), ("b", float("nan"), "x"), ("c", float("inf"), "x"), ("d", -1.0, "x"), ("", 1.0, "x"), (None, 1.0, "x"), ("e", None, "x"), ("f", 0.0, None)]
    schema = "idempotency_key string, quantity double, note string"
    for some in (rows, rows[::-1]):
        assert {tuple(r) for r in ledger.idempotent(spark.createDataFrame(some, schema)).collect()} == {("a", 1.0, "w"), ("f", 0.0, None)}


def test_code_questions_and_sealed_columns(spark):
    from quillmere.operators import ingestion, retrieval

    asks = spark.createDataFrame([("The class in that module",), ("Show me the code of it",), ("where is the office",), ("what is our deployment policy",)], "q string")
    low = F.lower("q")
    assert [r.c for r in asks.select((low.rlike(retrieval.CODE_PLACES) & low.rlike(retrieval.CODE_NOUNS)).alias("c")).collect()] == [True, True, False, False]
    rows = spark.createDataFrame([(i % 2, "same") for i in range(6)], "t int, v string").withColumn("t", F.col("t").cast("string"))
    key = ingestion.tenant_key(F.col("t"), "secret")
    sealed = rows.withColumn("s", ingestion.sealed(F.col("v"), key, F.col("t")))
    assert len({bytes(r.s) for r in sealed.collect()}) == 6
    other = ingestion.opened(F.col("s"), key, F.lit("9"))
    assert {(r.a, r.b) for r in sealed.select(ingestion.opened(F.col("s"), key, F.col("t")).alias("a"), other.alias("b")).collect()} == {("same", None)}


def test_merge_candidates_takes_lines_of_whole_documents(spark, tmp_path):
    from quillmere.plans import catalog

    lines = ["budget plan"] * 30 + [""] * 20 + ["travel costs next"] + ["plan budget"] * 5 + ["hiring of new people"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.id: r.title for r in catalog.queries()["merge_candidates"](spark, str(tmp_path)).collect()}
    # Confidences: travel .7 (line 50), budget .1 (line 0), the rest 0: eleven places, of which blank lines take what is left.
    assert found == {50: "travel costs next", 0: "budget plan"} | {i: "" for i in range(30, 40)}


def test_names_of_people_in_fields(spark):
    line = 'Owner: developer-ada, all Data., "Bob Stone", Unassigned, Assistant AI, None, billing, a b c d E, x@example.org, Ada O., Not stated'
    assert one(spark, strings.owner_names(F.col("t")), t=line) == ["developer-ada", "Bob Stone", "Ada O."]
    assert one(spark, strings.is_person(F.col("t")), t="0b9a1c52-1111-2222-3333-444455556666") is False
    assert one(spark, strings.is_person(F.col("t")), t="A" * 61) is False


def test_costs_are_cut_off_after_scaling(spark):
    uses = spark.createDataFrame([(1, "voice_synthesis", n, str(n)) for n in (4, 9, 0)] + [(1, "forecast_target", 1, "t"), (1, "unknown", 5, "u")], "tenant_id int, feature string, counted long, idempotency_key string")
    assert {r.idempotency_key: (r.cost_micros, r.unit) for r in ledger.metered(uses).collect()} == {"4": (9, "kchar"), "9": (21, "kchar"), "t": (120_000, "month")}


def test_unmetered_uses_cost_and_charge_nothing(spark):
    calls = spark.createDataFrame(
        [(1, "r1", "search", "m", 3, None, 40), (1, "r1", "search", "m", 3, None, 40), (1, "r2", "prompt", None, None, None, None), (1, "r3", None, "m", 1, 1, -5), (1, None, None, "m", 1, 1, 5)],
        "tenant_id int, request_id string, surface string, model string, input_tokens long, output_tokens long, cost_micros long",
    )
    found = {r.idempotency_key: r for r in ledger.model_calls(calls).collect()}
    assert set(found) == {"llm:r1", "llm:r2"} and {r.credits for r in found.values()} == {0.0}
    assert (found["llm:r1"].feature, found["llm:r1"].cost_micros, found["llm:r1"].metadata) == ("search", 40, '{"input_tokens":"3","model":"m","surface":"search","unmetered":"true"}')
    assert (found["llm:r2"].feature, found["llm:r2"].cost_micros, found["llm:r2"].metadata, found["llm:r2"].unit) == ("chat", 0, '{"surface":"prompt","unmetered":"true"}', "run")
    assert ledger.unmetered(ledger.model_calls(calls).withColumn("metadata", F.create_map(F.lit("a"), F.lit("b"))).withColumn("feature", F.lit("meeting_agent"))).count() == 0


def test_largest_feature_of_equal_ones_is_the_smaller_name(spark):
    rows = [(1, "a", "meeting_notes", 1, 2), (1, "a", "meeting_agent", 1, 2)]
    for order in (rows, rows[::-1]):
        usage = spark.createDataFrame(order, "tenant_id int, actor string, feature string, quantity int, credits int").withColumn("occurred_at", F.lit("2026-01-02").cast("timestamp_ntz"))
        assert [r.top_feature for r in ledger.top_consumers(usage, "2026-01-01", "2026-02-01").collect()] == ["meeting_agent"]


def test_common_titles_are_compared_once(spark):
    """Many candidates and many known blocks of one title: each candidate gets the most recent known one, without all pairs of them."""
    rows = lambda n, at: [(at + i, "t", "Weekly report of sales", f"body {'abc'[i % 3] * 4} words", i) for i in range(n)]
    schema = "id long, type string, title string, body string, recency long"
    new, known = spark.createDataFrame(rows(3000, 0) + [(9001, "u", "weekly sales report", "x", 0), (9002, "t", "the", "x", 0), (9003, "t", None, None, 0)], schema), spark.createDataFrame(rows(3000, 10_000), schema)
    found = {r.id: (r.action, r.known_id) for r in knowledge.reconcile(new, known).collect()}
    assert len(found) == 3003 and {found[i] for i in range(3000)} == {("skip", 10_000), ("update", 10_000)} and found[9001] == found[9002] == found[9003] == ("create", None)


def test_rosters(spark):
    rows = [("Ada Obi", "Living map", True), ("ada obi", "Admin page", False), ("Bob", "x" * 60, True), ("Cleo", "note", False), (" ", "t", True), (None, "t", True)] + [("Bob", f"task {i}", True) for i in range(4)]
    found = people.roster(people.people(spark.createDataFrame([("s", *r) for r in rows], "source string, name string, title string, owns boolean"), "source"), "source").first().roster
    assert found == (
        "**Bob**, **Ada Obi**\n\n| Person | Items | Assigned work |\n| --- | --- | --- |\n| Bob | 5 | task 0; task 1; task 2 +2 more |\n| Ada Obi | 2 | Admin page; Living map |"
        "\n\nAlso appearing as document authors (may include workspaces or bots, not only people): Cleo."
    )
    assert one(spark, people.item_list(F.array(F.repeat(F.lit("y"), F.lit(60))))) == "y" * 47 + "…" and one(spark, people.item_list(F.array().cast("array<string>"))) == "—"
    for question, terms in (("Who are the devs in the company?", []), ("Who made the edit of coding best practices?", ["edit", "coding", "best", "practices"]), (None, []), ("WHO works on PR 12 now?", [])):
        assert one(spark, people.subject_terms(F.col("q").cast("string")), q=question) == terms and one(spark, people.asks_for_everyone(F.col("q").cast("string")), q=question) == (terms == [])


def test_outlook(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 5.0, 0.0), (2, 90.0, 10.0, 150.0, 100.0), (3, 120.0, 10.0, 150.0, 100.0), (4, 10.0, 1.0, 95.0, 100.0), (5, 10.0, 1.0, 20.125, 100.0)], "tenant_id int, used double, mean_7d double, projected double, included double")
    found = {r.tenant_id: r for r in ledger.projected_words(rows.withColumn("state", ledger.projection_state(F.col("projected"), F.col("included"))), "2026-01-01 00:00:00").collect()}
    assert [(str(found[i].exhausted_at) if found[i].exhausted_at else None) for i in range(1, 6)] == [None, "2026-01-02 00:00:00", "2026-01-01 00:00:00", None, None]
    assert [found[i].sentence for i in range(2, 6)] == ["Projected to exceed by about 50 credits."] * 2 + ["Close — projected to use about 95% of your allowance.", "On track — about 79.88 credits to spare."]


def test_covariates_there_and_back(spark):
    words = ["north", "south"]
    rows = spark.createDataFrame([("north",), ("south",), ("west",), (None,)], "v string").withColumn("c", forecast.covariate_code(F.col("v"), words))
    found = rows.select("c", forecast.covariate_value(F.col("c"), words).alias("v"), forecast.covariate_value(F.lit(9), words).alias("w")).collect()
    assert [(r.c, r.v, r.w) for r in found] == [(1, "north", None), (2, "south", None), (0, None, None), (0, None, None)]
