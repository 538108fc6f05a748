"""A sink for vectors: points are normalised, sent in hundreds, and what failed comes back by id."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.sources import staging

#: Points in one call.
UPSERT = 100
#: Shorter vectors are left as they are, as their direction says nothing.
LEAST_NORM = 1e-10


class Sink(Protocol):
    """A store of points under their ids. A point that comes again replaces the one before."""

    def upsert(self, points: pd.DataFrame) -> dict[str, str]:
        """Stores points (chunk_id, vector, payload); returns the ids that it refused, with reasons. An exception refuses them all."""


def normalised(points: DataFrame, dimensions: int | None = None) -> DataFrame:
    """vector at length one in double precision, and error for what isn't a vector: null, empty, of other dimensions, or with a component that is no number."""
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.size("vector") > 0 if dimensions is None else F.size("vector") == dimensions
    good = F.coalesce(size & finite, F.lit(False))
    return points.withColumn("error", F.when(~good, "not a vector")).withColumn("vector", F.when(good, F.when(norm < LEAST_NORM, v).otherwise(F.transform(v, lambda x: x / norm))))


def sent(points: DataFrame, sink: Callable[[], Sink], dimensions: int | None = None, size: int = UPSERT) -> DataFrame:
    """Sends points (chunk_id: string, vector, payload: string) and returns chunk_id and error (null: stored) of each, as a written table.

    sink is called once in each task. A call that raises fails its points only; the others go on. Points are sent again when a task is run
    again, which changes nothing, as they replace themselves. Of points that share an id one is sent, the smallest by payload and vector.
    """
    once = normalised(points.select("chunk_id", "vector", F.coalesce("payload", F.lit("")).alias("payload")), dimensions)
    once = once.groupBy("chunk_id").agg(F.min(F.struct("error", "payload", "vector")).alias("p")).select("chunk_id", "p.*")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = sink()
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            some = pd.concat(held, ignore_index=True)
            held.clear()
            out = []
            for i in range(0, len(some), size):
                block = some.iloc[i : i + size]
                try:
                    refused = store.upsert(block[["chunk_id", "vector", "payload"]])
                except Exception as raised:  # noqa: BLE001  whatever a store raises, its points have failed
                    refused = dict.fromkeys(block["chunk_id"], f"{type(raised).__name__}: {raised}"[:200])
                out.append(pd.DataFrame({"chunk_id": block["chunk_id"], "error": [refused.get(c) for c in block["chunk_id"]]}))
            return pd.concat(out, ignore_index=True)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                yield flush()
        if held:
            yield flush()

    good = once.where("error IS NULL").select("chunk_id", "vector", "payload").mapInPandas(send, "chunk_id string, error string")
    return staging.written(good.unionByName(once.where("error IS NOT NULL").select("chunk_id", "error")), "vectors-sent")


class TableSink:
    """Points in a shared folder as Parquet, a file for each call, named by what is in it: a call that is made again writes the same file."""

    def __init__(self, path: str, version: int, refuse: Callable[[str], str | None] = lambda chunk_id: None):
        path = re.sub(r"^file:/+", "/", path).rstrip("/")
        self._fs, self._root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self._version, self._refuse = version, refuse

    def upsert(self, points: pd.DataFrame) -> dict[str, str]:
        refused = {c: why for c in points["chunk_id"] if (why := self._refuse(c))}
        kept = points[~points["chunk_id"].isin(refused.keys())].sort_values("chunk_id")
        if len(kept):
            table = pa.table({
                "chunk_id": pa.array(kept["chunk_id"], pa.string()), "vector": pa.array(kept["vector"].tolist(), pa.list_(pa.float64())), "payload": pa.array(kept["payload"], pa.string()),
                "version": pa.array([self._version] * len(kept), pa.int64()),
            })
            digest = hashlib.sha256("\n".join([str(self._version), *kept["chunk_id"]]).encode()).hexdigest()
            self._fs.create_dir(self._root, recursive=True)
            with self._fs.open_output_stream(f"{self._root}/{digest}.parquet") as out:
                pq.write_table(table, out)
        return refused


def contents(spark: SparkSession, path: str) -> DataFrame:
    """The points of a TableSink's folder: of each id the one of the highest version."""
    every = spark.read.schema("chunk_id string, vector array<double>, payload string, version long").parquet(path)
    newest = every.groupBy("chunk_id").agg(F.max_by(F.struct("vector", "payload", "version"), F.struct("version", "payload", "vector")).alias("p"))
    return newest.select("chunk_id", "p.*")
