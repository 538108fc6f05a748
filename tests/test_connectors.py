"""Mapping, files, code, wiki pages, excerpts, dates and ledger rows, against what was written by hand or by brute force."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.operators import connectors, drafts, forecast, ledger, retrieval, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_mapping_keeps_metadata_and_refuses_unknown_sources(spark):
    schema = "source string, content string, author string, timestamp string, subject string, connector_id string, external_id string, metadata map<string,string>, extra int"
    rows = [("custom", '{"text": "t"}', None, "1700000000", "s", "c", "e", {"title": "old", "a": "b"}, 1), ("gmail", '{"body": "t"}', " x ", None, "", None, "e", None, 2), ("brain", None, None, "?", "n", "c", None, {}, 3)]
    found = {r.extra: r for r in connectors.mapped(spark.createDataFrame(rows, schema)).collect()}
    assert found[1].content == "t" and found[1].author == "Unknown" and found[1].metadata == {"a": "b", "connector_id": "c", "external_id": "e", "title": "s"}
    assert found[2].content == '{"body": "t"}' and found[2].author == "x" and found[2].metadata == {"external_id": "e"} and found[2].timestamp is None
    assert found[3].author == "ai" and found[3].content is None
    with pytest.raises(Exception, match="no mapping"):
        connectors.mapped(spark.createDataFrame([("fax", *rows[0][1:])], schema)).collect()


def test_languages_of_paths(spark):
    cases = {"a/b.tsx": "js", "Dockerfile": "text", "README": "markdown", ".env": None, "x/node_modules/a.js": None, "a.min.js": None, "yarn.lock": None, "deep/a.tar.gz": None, "c.SQL": "text", "noext": None, "migrations/1.sql": None, "outer/a.py": "python"}
    found = spark.createDataFrame([(p,) for p in cases], "p string").select("p", connectors.code_language(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in found} == cases


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=4000), st.sampled_from(["python", "text", "go"]))
def test_pieces_lie_in_their_file(content, language):
    pieces = connectors._pieces(content, language)
    lines = content.split("\n")
    for line, piece in pieces:
        assert len(piece) <= connectors.CODE_CHARS
        assert "\n".join(lines[line - 1 :]).startswith(piece) or piece in "\n".join(lines[line - 1 :])
    kept = "".join(p for _, p in pieces)
    assert kept.count("a") >= content.count("a") and kept.count("b") >= content.count("b")


def test_pieces_begin_at_declarations(spark):
    source = "import os\n\n" + "".join(f"def f{i}(x):\n    y = x + {i}\n    return y * {i}\n\n" for i in range(200))
    frame = spark.createDataFrame([("r", "src/a.py", source), ("r", "src/b.py", ""), (None, "c.py", "x = 1"), ("r", None, "x"), ("r", "d.py", None)], "repo string, path string, content string")
    rows = connectors.code_chunks(frame).collect()
    lines = source.split("\n")
    own = [r for r in rows if r.path == "src/a.py"]
    assert len(own) > 5 and {r.path for r in rows} == {"src/a.py", "c.py"}
    for r in own:
        assert "\n".join(lines[r.line - 1 :]).startswith(r.body) and r.text.startswith(f"# src/a.py\nrepository: r | language: python | L{r.line} | part {r.part}/{len(own)}\n\n")
    stripped = spark.createDataFrame([(r.text, r.body) for r in rows], "t string, b string").where(connectors.without_header(F.col("t")) != F.col("b"))
    assert stripped.count() == 0


def test_wiki_lines(spark):
    def line(kind, *values):
        return one(spark, connectors.property_line(F.lit("k"), F.lit(kind), F.array(*map(F.lit, values)).cast("array<string>")))

    assert line("date", "a", "b") == "k: a → b" and line("date", "a") == "k: a" and line("select", "") is None and line("people", "x", "", "y") == "k: x, y"
    assert line("checkbox", "false") == "k: No" and line("relation", "1", "2") == "k: 2 linked item(s)" and line("title", "t") is None and line("unique_id", "T", "7") == "k: T-7"
    assert one(spark, connectors.block_line(F.lit("to_do"), F.lit(" x "), F.lit("true"))) == "- [x] x"
    assert one(spark, connectors.block_line(F.lit("bookmark"), F.lit(None).cast("string"), F.lit("u"))) == "u"
    assert one(spark, connectors.block_line(F.lit("divider"), F.lit("x"), F.lit("u"))) is None
    assert one(spark, connectors.page_document(F.lit("(untitled)"), F.lit(" "), F.lit("b"), F.lit("c"))) == "b\n\n## Discussion\nc"
    assert not one(spark, connectors.has_substance(F.lit("# T\n\n short"), F.lit("T"))) and one(spark, connectors.has_substance(F.lit("# T\n\n long enough"), F.lit("T")))


def brute_excerpt(terms, content, most):
    clean = content.strip()
    lines = [x for x in clean.split("\n") if x.strip()]
    if len(clean) <= most:
        return clean
    if len(lines) <= 1:
        return clean[:most]
    runs = []
    for start in range(len(lines)):
        run = [lines[start]]
        for line in lines[start + 1 :]:
            if sum(len(x) + 1 for x in run) + len(line) + 1 > most:
                break
            run.append(line)
        runs.append((-sum(t in x.lower() for x in run for t in terms), start, " ".join(run)))
    _, start, passage = min(runs)
    return ("… " if start else "") + passage


def test_excerpts_equal_brute_force(spark):
    texts = ["\n".join("ab cd ef"[(i * j) % 7 :] * ((i + j) % 4 + 1) for j in range(i)) for i in range(40)] + ["", "x" * 90, "ab" * 50 + "\nz" + "\nab cd" * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r.excerpt for r in retrieval.excerpts(frame, ["ab", "cd"], 40).collect()}
    assert found == {i: brute_excerpt(["ab", "cd"], t, 40) for i, t in enumerate(texts)}
    headed = spark.createDataFrame([(1, "## Head\n" + "a\n" * 40 + "needle"), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.excerpt for r in retrieval.excerpts(headed, ["needle"], 20).collect()} == {1: "Head — … a a a a a a needle", 2: ""}


def test_dates(spark):
    day = datetime.date
    cases = [("3/4/1999", 2000, day(1999, 3, 4)), ("3/4/1999", 1985, day(1999, 4, 3)), ("25.12.49", 2000, None), ("25.12.29", 2000, day(2029, 12, 25)), ("12-25-50", 2000, day(1950, 12, 25)), ("1st March 2001", 2000, day(2001, 3, 1)), ("Feb 30, 2001", 2000, None), ("1899-01-01", 2000, None), ("words", 2000, None), (None, 2000, None)]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, t string, era int")
    found = frame.select("i", text.parsed_date(F.col("t"), F.col("era")).alias("d")).orderBy("i").collect()
    assert [r.d for r in found] == [c[2] for c in cases]


def test_bytes(spark):
    rows = [(bytearray("né".encode("cp1252")), True, "né"), (bytearray(b"\xff"), False, "�"), (bytearray("né".encode()), True, "né"), (None, True, None)]
    found = spark.createDataFrame([(*r[:2], i) for i, r in enumerate(rows)], "b binary, w boolean, i int").orderBy("i").select(text.decoded(F.col("b"), F.col("w")).alias("t")).collect()
    assert [r.t for r in found] == [r[2] for r in rows]


def test_jaccard_of_signatures(spark):
    found = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 0, 4])], "a array<int>, b array<int>").select(text.jaccard_estimate(F.col("a"), F.col("b")).alias("j")).first().j
    assert found.estimate == 0.75 and abs(found.sigma - (0.75 * 0.25 / 4) ** 0.5) < 1e-12


def test_candidates_of_broken_answers(spark):
    rows = [(1, None), (2, ""), (3, "no array"), (4, "```JSON\n[{\"title\": \"t\", \"body\": \"b\", \"confidence\": 2}]\n```"), (5, "[]"), (6, '[{"type": "note", "title": " ", "body": "b"}]')]
    found = drafts.candidates(spark.createDataFrame(rows, "id int, answer string")).collect()
    assert [(r.id, r.type, r.title, r.body, r.confidence) for r in found] == [(4, "learned_fact", "t", "b", 0.6)]


def test_signal_and_states(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, float("nan")), (2, None), (3, float("inf")), (3, 1.0), (3, 2.0)], "k int, v double")
    assert {r.k: r.s for r in frame.groupBy("k").agg(forecast.has_signal("v").alias("s")).collect()} == {1: False, 2: False, 3: True}


def test_ledger_rows(spark):
    batches = spark.createDataFrame([("t", "b", "2024-01-02", 3000), ("t", "b", "2024-01-02", 3000), ("t", "a", "2024-01-01", 4000), ("t", "z", "2024-01-03", 0)], "tenant_id string, batch_id string, at string, documents int")
    found = {r.idempotency_key: (r.quantity, r.credits) for r in ledger.ingest_batches(batches, F.lit(5000)).collect()}
    assert found == {"ingest-volume:a": (4.0, 0.0), "ingest-volume:b": (3.0, 0.0), "ingest:b": (2.0, 20.0)}
    refunds = spark.createDataFrame([("t", "api_request", 1, 5.0), ("t", "api_request", 1, 7.0), ("t", "api_request", 2, -1.0), ("t", "api_request", None, 1.0)], "tenant_id string, feature string, event_id int, credits double")
    assert [(r.credits, r.idempotency_key) for r in ledger.corrections(refunds).collect()] == [(-7.0, "correction:1")]
    assert ledger.metered(spark.createDataFrame([], "tenant_id string, feature string, counted int, idempotency_key string")).count() == 0
