import os
import shutil

import corpus_pipeline
from quillmere.llm import exact_dedup, queries
from tests.llm.test_near_dedup import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_on_the_smallest_tables(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    columns, docs, at = documents.columns, documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        at[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = {}
    for d, t in at["toxicity"].items():
        best[low(t)] = max(d, best.get(low(t), -1))
    assert set(at["exact_dedup"]) == set(best.values())
    groups = brute(list(at["exact_dedup"].items()), 5, 80)
    assert set(at["near_dedup"]) == {d for d, (_, c) in groups.items() if d == c}
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(at["near_dedup"])


def test_empty_documents(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "documents.parquet":
            (shutil.copytree if os.path.isdir(f"{SF}/{name}") else shutil.copy)(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    found = {name.split("_")[0] for name in queries.queries()}
    assert found == {f"op{n}" for n in range(1, 14)} and set(queries.oracle_sql()) <= set(queries.queries())


def test_rows_that_share_a_doc_id_are_documents_of_their_own(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(5, "alpha beta"), (9, "Alpha beta"), (5, "wholly other text"), (None, "no id"), (7, near), (8, near + " end"), (8, "apart from that"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, number string")
    kept = corpus_pipeline.exact_dedup_stage(spark, docs, SF)
    assert kept.columns == columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(rows[1:], key=str)
    kept = corpus_pipeline.near_dedup_stage(spark, kept, SF)
    assert kept.columns == columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows[1:] if r != rows[5]], key=str)


def test_large_doc_ids_go_through_all_stages(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    top = 2**63 - 1
    rows = [(top, "alpha beta"), (top - 1, "Alpha beta"), (top - 8, "beta gamma"), (top - 9, "BETA gamma"), (top - 5, "apart from that")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    half = exact_dedup.lower_half(docs)
    assert {r.doc_id for r in docs.where(half).collect()} == {top - 5, top - 8, top - 9}
    assert docs.where(exact_dedup.lower_half(docs.limit(0))).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {top, top - 8, top - 5}
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {top, top - 8, top - 5} and len(packed) == 3


def test_op4_takes_large_doc_ids(spark, tmp_path):
    top = 2**63 - 1
    spark.createDataFrame([(top, "A b"), (top - 3, "a b"), (top - 2, "c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in queries.queries()["op4_exact_dedup"](spark, str(tmp_path)).collect()}
    assert found == {top: (top, 2, True), top - 3: (top, 2, False), top - 2: (top - 2, 1, True)}
