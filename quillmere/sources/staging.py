"""Intermediate tables in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_left: dict[str, SparkSession] = {}


#: Rows of one Arrow batch of whole texts, where the session has Spark's own default: a worker holds a batch several times.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder in the warehouse, which is shared as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/quillmere"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet and reads it again."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _left[path] = spark
    out = spark.read.schema(frame.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing to come reads; other frames are left alone."""
    for frame in frames:
        path = _paths.pop(frame, None)
        if path:
            _delete(_left.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
