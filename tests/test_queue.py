import pytest
from pyspark.sql import functions as F

from quillmere.sources import queue
from quillmere.streaming import ingest


def messages(spark, numbers):
    return spark.createDataFrame([(f"k{i}", f"v{i}") for i in numbers], "key string, value string").repartition(2)


def drained(spark, path, out, check, group="g"):
    stream = spark.readStream.format("queue").option("path", path).option("group", group).load()
    ingest.drained(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
    return sorted(r.value for r in spark.read.schema(queue.READ).parquet(out).collect())


def test_messages_are_read_once_over_restarts(spark, tmp_path):
    queue.register(spark)
    path, out, check = str(tmp_path / "q"), str(tmp_path / "out"), str(tmp_path / "check")
    messages(spark, range(5)).write.format("queue").mode("append").option("path", path).option("writer", "a").save()
    assert queue.depth(path) == queue.depth(path, "g") == 5
    assert drained(spark, path, out, check) == [f"v{i}" for i in range(5)]
    messages(spark, range(5, 8)).write.format("queue").mode("append").option("path", path).save()
    # the same named batch again adds nothing
    messages(spark, range(5)).write.format("queue").mode("append").option("path", path).option("writer", "a").save()
    assert queue.depth(path) == 8
    assert drained(spark, path, out, check) == [f"v{i}" for i in range(8)]
    assert drained(spark, path, out, check) == [f"v{i}" for i in range(8)]
    left = spark.read.format("queue").option("path", path).load()
    assert left.count() == 8 and left.groupBy("writer", "batch", "position").count().where("count > 1").count() == 0


def test_stream_to_queue_to_stream(spark, tmp_path):
    queue.register(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "q")
    messages(spark, range(20)).write.json(source)
    stream = spark.readStream.schema(queue.MESSAGE).json(source)
    for _ in range(2):
        write = stream.writeStream.format("queue").option("path", path).option("writer", "s").option("checkpointLocation", str(tmp_path / "w"))
        ingest.drained(write.trigger(availableNow=True).start())
    assert queue.depth(path) == 20
    assert drained(spark, path, str(tmp_path / "out"), str(tmp_path / "r")) == sorted(f"v{i}" for i in range(20))


def test_failed_commits_are_replayed_and_published_once(tmp_path):
    import pyarrow as pa

    folder = queue.Folder(str(tmp_path))
    rows = lambda *v: iter([pa.record_batch([pa.array(v), pa.array(v)], names=["key", "value"])])
    first = queue.StreamWriter({"path": str(tmp_path), "writer": "w"})
    lost = first.write(rows("a"))
    first.abort([lost, None], 0)  # the batch failed: nothing is there
    assert folder.depth() == 0 and folder.published() == {}
    again = first.write(rows("a"))
    first.commit([again], 0)
    replayed = first.write(rows("a"))
    first.commit([replayed], 0)  # Spark died before it noted the commit, and runs the batch again
    assert folder.depth() == 1 and [s.name for s in folder.segments("w", 0)] == [again.name]
    folder.acknowledge("g", {"w": 0})
    folder.acknowledge("g", {"w": -1})
    assert folder.depth("g") == 0 and folder.depth("other") == 1
    assert not list((tmp_path / "staged" / "w").iterdir())


def test_queues_refuse_what_is_no_message(spark, tmp_path):
    queue.register(spark)
    with pytest.raises(Exception, match="messages are"):
        spark.range(1).write.format("queue").mode("append").option("path", str(tmp_path / "q")).save()
    with pytest.raises(Exception, match="appended"):
        messages(spark, [1]).write.format("queue").mode("overwrite").option("path", str(tmp_path / "q")).save()
    with pytest.raises(ValueError, match="not a name"):
        queue.BatchWriter({"path": "x", "writer": "a/b"})
    assert spark.read.format("queue").option("path", str(tmp_path / "none")).load().select(F.count("*")).first()[0] == 0
