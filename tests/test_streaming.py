import datetime as dt
import json

from pyspark.sql import types as T

from quillmere.streaming import ingest


def test_ingest_writes_chunks_rejects_and_statuses(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    good = {"raw_document_id": "d1", "source": "notion", "external_id": "e", "author": " ", "content": "Some text that is long enough. " * 200, "timestamp": "2026-01-01", "namespace": "u:notion"}
    (landing / "a.json").write_text(json.dumps(good) + "\n" + json.dumps(good | {"raw_document_id": "d2", "content": "  "}) + "\nnot json\n")
    out = str(tmp_path / "out")
    ingest.drained(ingest.ingest(ingest.landing(spark, str(landing)), out, str(tmp_path / "check")))
    chunks = spark.read.parquet(f"{out}/chunks").collect()
    assert {c.doc_id for c in chunks} == {"d1"} and len(chunks) == 3 and {c.author for c in chunks} == {"Unknown"}
    assert sorted(str(r.error) for r in spark.read.parquet(f"{out}/rejected").collect()) == ["missing content", "missing raw_document_id"]
    assert spark.read.parquet(f"{out}/status").count() == 3


def _events(tmp_path, rows):
    folder = tmp_path / "events"
    folder.mkdir(exist_ok=True)
    for i, batch in enumerate(rows):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"event_id": e, "ts": t.isoformat(), "kind": k}) for e, t, k in batch))
    return str(folder)


SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType())])


def test_deduplicated_equals_batch(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    path = _events(tmp_path, [[(i % 40, start + dt.timedelta(seconds=i % 40), "a") for i in range(100)]])
    stream = spark.readStream.schema(SCHEMA).json(path)
    assert ingest.to_memory(ingest.deduplicated(stream), "deduplicated").count() == spark.read.schema(SCHEMA).json(path).select("event_id").distinct().count() == 40


def test_tumbling_windows(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    path = _events(tmp_path, [[(i, start + dt.timedelta(minutes=i), "a") for i in range(60)], [(99, start + dt.timedelta(hours=5), "b")]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    found = ingest.to_memory(ingest.tumbling(stream, "10 minutes"), "tumbling").collect()
    assert [r.n for r in found] == [10] * 6


def test_bucket_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "buckets"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps({"doc_id": d, "band": 0, "bucket": b}) for d, b in ((3, "x"), (5, "x"), (4, "y"))))
    (folder / "1.json").write_text(json.dumps({"doc_id": 9, "band": 0, "bucket": "x"}))
    stream = spark.readStream.schema("doc_id long, band int, bucket string").option("maxFilesPerTrigger", 1).json(str(folder))
    found = {(r.doc_id, r["first"]) for r in ingest.to_memory(ingest.bucket_matches(stream), "bucket_matches", timed=True).collect()}
    assert found == {(5, 3), (9, 3)} or found == {(3, 9), (5, 9)}
