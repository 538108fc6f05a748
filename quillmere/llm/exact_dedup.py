"""Exact deduplication of a batch against an immutable snapshot, screened by binary-fuse filters.

The snapshot keeps one row for each distinct text, in buckets by digest, with a static 8-bit
binary-fuse filter for each bucket. A batch is first grouped by digest itself. Its distinct digests
then ask their bucket's filter; only positives are joined to the snapshot's bucket, and their texts are
compared byte by byte, so that neither a false positive nor a colliding digest joins two texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm import support

#: Distinct digests in one bucket, about; a filter of so many has some 110 kB.
BUCKET_ROWS = 100_000
#: Stands for a null doc_id where texts are fetched. A row that has this number itself may be fetched instead, but only with the same digest, and bytes are compared.
NO_ID = -(2**63)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of keys and seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class FuseFilter:
    """A static set of 64-bit keys in about nine bits each: no false negatives, 1 in 256 false positives.

    Three-wise binary fuse: a key's slots lie in three neighbouring segments, and its 8-bit fingerprint
    is the exclusive or of what they hold. Slots are settled by peeling in rounds: all keys that own a
    slot alone are taken off together, then filled in from the last round to the first.
    """

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int64) * segment
        mask = segment - 1
        h = h.astype(np.int64)
        return np.stack([first + (h & mask), first + segment + ((h >> 10) & mask), first + 2 * segment + ((h >> 20) & mask)])

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << min(10, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        for seed in range(1, 200):
            room *= 1.02 if seed > 4 else 1
            segments = max(1, int(np.ceil(room * n / segment)) - 2)
            size = (segments + 2) * segment
            h = _mix(keys, seed)
            slots = cls._slots(h, segment, segments)
            rounds, places = cls._peel(slots, size)
            if sum(map(len, rounds)) < n:
                continue
            print_of = (h ^ (h >> np.uint64(32))).astype(np.uint8)
            cells = np.zeros(size, np.uint8)
            for rows, alone in zip(reversed(rounds), reversed(places)):
                s = slots[:, rows]
                value = print_of[rows] ^ cells[s[0]] ^ cells[s[1]] ^ cells[s[2]]
                cells[alone] ^= value
            return cls(seed, segment, segments, cells)
        raise RuntimeError("no seed settles the filter")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rounds of keys that own a slot alone when those before are gone, and these slots."""
        ids = np.arange(slots.shape[1], dtype=np.int64)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, ids)
        rounds, places = [], []
        alone = np.flatnonzero(count == 1)
        while len(alone):
            rows, first = np.unique(owner[alone], return_index=True)
            places.append(alone[first])
            rounds.append(rows)
            for row in slots[:, rows]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, rows)
            touched = np.unique(slots[:, rows].ravel())
            alone = touched[count[touched] == 1]
        return rounds, places

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, np.uint64), self.seed)
        s = self._slots(h, self.segment, self.segments)
        return (h ^ (h >> np.uint64(32))).astype(np.uint8) == self.cells[s[0]] ^ self.cells[s[1]] ^ self.cells[s[2]]

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.cells.tobytes()

    @classmethod
    def load(cls, data: bytes) -> FuseFilter:
        return cls(*np.frombuffer(data[:24], "<i8").tolist(), np.frombuffer(data[24:], np.uint8))


def _key(digest: Column) -> Column:
    """The digest's first 60 bits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _fetched(doc_id: str) -> Column:
    """The id that a row's text is fetched by, NO_ID for none, so that joins on it are plain equalities."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def normalised(text: Column) -> Column:
    """The text that decides: A-Z lower-cased, null as empty."""
    return support.ascii_lower(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text_sha256 (hex, of the normalised text in UTF-8), n_bytes and the carried columns of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"), *carried).select(
        "doc_id", F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").alias("n_bytes"), *carried
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row for each distinct text of a batch or snapshot: its largest doc_id and its rows, summed before the shuffle."""
    return rows.groupBy("text_sha256", "n_bytes").agg(F.max("doc_id").alias("rep"), F.count("*").alias("n"))


def bucketed(own: DataFrame, buckets: int) -> DataFrame:
    return own.withColumn("bucket", F.pmod(F.xxhash64("text_sha256"), F.lit(buckets)).cast("int"))


def filters(snapshot: DataFrame) -> DataFrame:
    """One serialised FuseFilter for each bucket of a snapshot's distinct texts."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "filter": [FuseFilter.build(frame["key"].to_numpy(np.uint64)).dump()]})

    return snapshot.select("bucket", _key(F.col("text_sha256")).alias("key")).groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screened(incoming: DataFrame, filter_table: DataFrame) -> DataFrame:
    """Incoming distinct texts that their bucket's filter may hold; the others are surely new.

    A bucket's digests and its one filter meet in a task; no task gets all filters.
    """

    def ask(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keep = FuseFilter.load(found["filter"].iloc[0]).has(rows["key"].to_numpy(np.uint64)) if len(found) else np.zeros(len(rows), bool)
        return rows.loc[keep, ["text_sha256", "n_bytes", "rep", "n"]]

    keyed = incoming.withColumn("key", _key(F.col("text_sha256")))
    return keyed.groupBy("bucket").cogroup(filter_table.groupBy("bucket")).applyInPandas(ask, "text_sha256 string, n_bytes int, rep long, n long")


def same_text(positives: DataFrame, snapshot: DataFrame, docs: DataFrame) -> DataFrame:
    """Positives whose text is, byte for byte, that of the snapshot's row with their digest.

    Returns text_sha256, n_bytes, rep and n of the batch, old and old_n of the snapshot. The two rows'
    texts are fetched by doc_id.
    """
    key = ["text_sha256", "n_bytes"]
    pairs = positives.join(snapshot.select(*key, F.col("rep").alias("old"), F.col("n").alias("old_n")), key)
    pairs = pairs.withColumn("rep_id", _fetched("rep")).withColumn("old_id", _fetched("old"))
    wanted = pairs.select(F.explode(F.array("rep_id", "old_id")).alias("id")).distinct()
    texts = docs.select(_fetched("doc_id").alias("id"), "text").join(wanted, "id", "left_semi").select("id", normalised(F.col("text")).alias("t"))
    # Rows that share a doc_id can have several texts; the digest picks the right one.
    texts = texts.withColumn("text_sha256", F.sha2("t", 256)).dropDuplicates(["id", "text_sha256"])
    new = texts.select(F.col("id").alias("rep_id"), "text_sha256", F.col("t").alias("new_t"))
    old = texts.select(F.col("id").alias("old_id"), "text_sha256", F.col("t").alias("old_t"))
    return (
        pairs.join(new, ["rep_id", "text_sha256"])
        .join(old, ["old_id", "text_sha256"])
        .where(F.col("new_t").cast("binary") == F.col("old_t").cast("binary"))
        .select(*key, "rep", "n", "old", "old_n")
    )


def lower_half(docs: DataFrame) -> Column:
    """Rows of docs in the lower half of the range of its doc_ids. Two large ids together don't fit a long, so they are added as decimals."""
    low, high = (f("doc_id").cast("decimal(20,0)") for f in (F.min, F.max))
    return F.col("doc_id") <= F.lit(docs.agg(F.floor((low + high) / 2).cast("long").alias("middle")).first().middle)


def deduplicate(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id and text, a table, as it is read twice; more columns are ignored. in_snapshot: which
    rows make up the snapshot; the others are the batch. The groups don't depend on it.

    Of equal normalised texts the largest doc_id stays; a null doc_id is smaller than any other. Null
    and empty texts are equal to each other. Where rows with equal texts share even the largest
    doc_id, all of these are marked as kept, as nothing tells them apart. No rows give no rows.
    """
    flag = F.coalesce(in_snapshot, F.lit(False))
    marked = support.materialise(digests(docs.withColumn("old", flag), "old"), "digests")
    total = marked.count()
    buckets = total // BUCKET_ROWS + 1
    key = ["text_sha256", "n_bytes"]
    old = support.materialise(bucketed(groups(marked.where("old")), buckets), "snapshot")
    new = support.materialise(bucketed(groups(marked.where("NOT old")), buckets), "batch")
    again = support.materialise(same_text(screened(new, filters(old)), old, docs), "again")
    new_groups = new.join(again.select(*key, "old", "old_n"), key, "left").select(
        *key, F.lit(False).alias("old"), F.greatest("rep", "old").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size")
    )
    old_groups = old.join(again.select(*key, F.col("rep").alias("new_rep"), F.col("n").alias("new_n")), key, "left").select(
        *key, F.lit(True).alias("old"), F.greatest("rep", "new_rep").alias("keep_id"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("group_size")
    )
    group = F.concat_ws(":", *key, F.col("old").cast("string")).alias("group")
    found = support.materialise(new_groups.unionByName(old_groups).select(group, "keep_id", "group_size"), "groups")
    joined = support.join_counted(marked.select("doc_id", "text_sha256", group), found, "group", "group_size", total)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
