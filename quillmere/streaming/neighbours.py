"""Near duplicates of a stream: buckets of locality-sensitive hashes in state, with the sets that links are confirmed on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmere.operators import graph, text

THRESHOLD, BANDS, ROWS = 0.85, 16, 8


def indexed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """bucket, doc_id, digest and set: each document in its buckets, with its shingles as 64-bit hashes. Works on tables and on streams alike."""
    shingled = docs.select("doc_id", text.shingles(F.col("text")).alias("s")).select("doc_id", F.transform("s", text.shingle_hash).alias("h"), F.array_sort(F.transform("s", lambda x: F.xxhash64(x))).alias("set"))
    signed = text.minhash(shingled, bands * rows, "set")
    parts = F.array(*(F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(bands)))
    digest = F.sha2(F.array_join(F.transform("set", lambda x: x.cast("string")), "|"), 256)
    return signed.select("doc_id", "set", digest.alias("digest"), F.explode(parts).alias("bucket")).select("bucket", "doc_id", "digest", "set")


class Bucket(StatefulProcessor):
    """Every distinct set that a bucket has had within the time to live, each under its digest with one of its documents."""

    def __init__(self, threshold: float, ttl_ms: int):
        self._threshold, self._ttl = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sets = handle.getMapState("sets", "digest string", "doc_id long, items array<long>", ttlDurationMs=self._ttl)

    def _insert(self, rows: Iterator[pd.DataFrame], compare: bool) -> list[tuple[int, int]]:
        new: dict[str, tuple[int, np.ndarray]] = {}
        links: list[tuple[int, int]] = []
        for frame in rows:
            for doc_id, digest, items in zip(frame["doc_id"], frame["digest"], frame["set"]):
                doc_id = int(doc_id)
                held = new.get(digest)
                if held is None and self._sets.containsKey((digest,)):
                    stored = self._sets.getValue((digest,))
                    held = (int(stored[0]), np.asarray(stored[1], np.int64))
                if held is not None:
                    links.append((doc_id, held[0]))
                new[digest] = (held[0] if held else doc_id, np.asarray(items, np.int64))
        if compare:
            fresh = [d for d in new if not self._sets.containsKey((d,))]
            seen = list(new.items())
            for digest, (doc_id, items) in ((d, new[d]) for d in fresh):
                for other, (other_id, other_items) in seen:
                    if other < digest or other not in fresh:
                        self._link(links, doc_id, items, other, digest, other_id, other_items)
            for key, value in self._sets.iterator():
                if key[0] not in new:
                    stored = np.asarray(value[1], np.int64)
                    for digest in fresh:
                        self._link(links, new[digest][0], new[digest][1], key[0], digest, int(value[0]), stored)
        for digest, (doc_id, items) in new.items():  # also renews the time to live of sets that came again
            self._sets.updateValue((digest,), (doc_id, items.tolist()))
        return links

    def _link(self, links, doc_id, items, other, digest, other_id, other_items) -> None:
        if other == digest:
            return
        common = len(np.intersect1d(items, other_items, assume_unique=True))
        if common >= self._threshold * (len(items) + len(other_items) - common):
            links.append((doc_id, other_id))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        yield pd.DataFrame(self._insert(rows, True), columns=["u", "v"], dtype="int64")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._insert(iter([initialState]), False)

    def close(self) -> None:
        pass


def links(stream: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD, days: int = 30) -> DataFrame:
    """u, v for a stream of indexed() rows: each document with every one before it, in its buckets, that is similar enough. Needs the RocksDB state store.

    Documents of one set are linked to the first of them, and others are compared with it alone. known: indexed() rows of what is there already, from a
    batch; they make the state that the stream starts with, and are linked to what comes but not to each other.
    """
    first = known.groupBy("bucket") if known is not None else None
    return stream.groupBy("bucket").transformWithStateInPandas(Bucket(threshold, days * 86_400_000), "u long, v long", "Append", "processingTime", first)


def classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and canonical, the smallest document of its class, from documents and the links that were found."""
    labels = graph.components(found.where("u <> v").distinct()).withColumnRenamed("node", "doc_id")
    return docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("canonical"))
