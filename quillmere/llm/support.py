"""What the training-data operators share: tables in the shared folder and joins with hot keys."""

from __future__ import annotations

import atexit
import os
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.sources import staging

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_written: list[tuple[SparkSession, str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: Rows of one Arrow batch, where the session has Spark's own default: documents are long, and a worker holds a batch several times.
BATCH_ROWS = 256
#: So that Python workers give memory back to the system between batches.
WORKER_ENVIRONMENT = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table. Also bounds Arrow batches, and lets local Python workers find this package wherever the driver runs."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    environment = spark.sparkContext.environment
    if "ARROW_DEFAULT_MEMORY_POOL" not in environment:
        environment.update(WORKER_ENVIRONMENT)
        if spark.sparkContext.master.startswith("local["):
            environment.setdefault("PYTHONPATH", REPO)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at; forget() deletes it."""
    path = f"{staging.folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage.

    Most of these tables hold hashes, which don't compress; codecs would only take buffers outside the executors' heap.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing to come reads; other frames are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, keep: int = 0) -> None:
    """Deletes tables that materialise() wrote, but for the last keep; results that read them end."""
    own = [x for x in _written if x[0] is spark]
    for item in own[: len(own) - keep]:
        _delete(spark, item[1])
        _written.remove(item)


@atexit.register
def _forget_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            forget(spark)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """Joins left, of total rows, to right, which has each key's rows and in count how many left has of it.

    Hot keys, with over one part in ``share`` of left's rows, are broadcast, so that no key's rows meet
    in one task. They are fewer than ``share`` keys whatever the data. All others are shuffled.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    is_hot = F.col(count) * F.lit(share) > F.lit(max(total, 1))
    hot, cold = right.where(is_hot), right.where(~is_hot)
    one = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return one.unionByName(rest.join(cold, key, how))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() is exact, and much faster, on texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
