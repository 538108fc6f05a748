"""Structured Streaming: documents from a landing folder, deduplicated events with late data, stateful near-duplicate buckets."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillmere.operators import ingestion, text

PAYLOAD = T.StructType([T.StructField(c, T.StringType()) for c in ("raw_document_id", "source", "external_id", "author", "content", "timestamp", "namespace")])


def landing(spark: SparkSession, path: str, schema: T.StructType = PAYLOAD, files_per_trigger: int | None = None) -> DataFrame:
    """Payloads from JSON files in a folder; what doesn't parse has null fields and is rejected later."""
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def ingest(payloads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes chunks, rejected payloads and statuses of each batch under ``out``; available input only.

    A batch's folder is overwritten when the batch is run again after a failure, so that nothing counts twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        checked = ingestion.rejected(rows).persist()
        try:
            bad, good = checked.where("error IS NOT NULL"), checked.where("error IS NULL")
            docs = good.select(F.col("raw_document_id").alias("doc_id"), text.surface_clean(text.nfc(F.col("content"))).alias("text"), ingestion.author(F.col("author")).alias("author"), "namespace", "source")
            chunks = text.chunks(docs.select("doc_id", "text")).join(docs.drop("text"), "doc_id")
            chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
            bad.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
            status = F.when(F.col("error").isNull(), "PROCESSED").otherwise("FAILED")
            checked.select("raw_document_id", status.alias("status"), "error").write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        finally:
            checked.unpersist()

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Each key once within the watermark; rows that come later than that are dropped by the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str, at: str = "ts", late: str = "2 minutes", *keys: str) -> DataFrame:
    """Counts in windows of one width, each window once when the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), *keys, "n")


class FirstInBucket(StatefulProcessor):
    """Keeps each bucket's first document for a while, and gives rows with the first that they meet."""

    def __init__(self, ttl_ms: int):
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "doc_id long", ttlDurationMs=self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        ids = sorted(int(x) for frame in rows for x in frame["doc_id"])
        first = self._first.get()[0] if self._first.exists() else None
        if first is None:
            first, ids = ids[0], ids[1:]
            self._first.update((first,))
        yield pd.DataFrame({"doc_id": ids, "first": [first] * len(ids)})

    def close(self) -> None:
        pass


def bucket_matches(buckets: DataFrame, days: int = 30) -> DataFrame:
    """doc_id, first of a stream of doc_id, band, bucket: documents that meet an earlier one, which is remembered for some days. Needs the RocksDB state store."""
    keyed = buckets.select(F.concat_ws(":", "band", "bucket").alias("key"), "doc_id")
    return keyed.groupBy("key").transformWithStateInPandas(FirstInBucket(days * 86_400_000), "doc_id long, first long", "Append", "processingTime")


def drained(query: StreamingQuery, seconds: int = 300) -> None:
    """Waits for a query over available input; raises if it failed or takes too long."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream has not ended in {seconds} s")


def to_memory(stream: DataFrame, name: str, mode: str = "append", timed: bool = False) -> DataFrame:
    """All available input of a stream in a table of the driver's memory, for small results such as those of tests.

    timed: for state with a time to live, whose batches go on without new input, so that the query has to be stopped.
    """
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    if timed:
        query, seen, end = writer.start(), -1, time.monotonic() + 120
        while query.isActive and time.monotonic() < end:
            done = query.lastProgress
            if done and done["batchId"] > seen >= 0 and done["numInputRows"] == 0:
                break
            seen = done["batchId"] if done else seen
            time.sleep(0.2)
        query.stop()
        if query.exception():
            raise query.exception()
    else:
        drained(writer.trigger(availableNow=True).start())
    return stream.sparkSession.table(name)
