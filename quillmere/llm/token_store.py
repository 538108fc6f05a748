"""Token ids in a binary format for short-document access, with one shared zstandard dictionary.

The store is a table of shards in ascending doc_id order. A shard is one binary value:

    magic "QMTS" | version u16 | bytes an id u16 | SHA-256 of the dictionary, 32 bytes | documents u64
    | doc_id of each, i64 | ids of each, u64 | end of each frame, u64 | frames

Each document's ids, little-endian, are a zstandard frame of their own, compressed with the store's
dictionary, so that one document is read through the index without its neighbours. The dictionary is
trained on the serialised ids of a bounded sample of documents and stored once beside the shards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm import support
from quillmere.llm.tokens import WORD_FILE, word_ids

END_ID = 1
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 16_384, 65_536
SHARD_BYTES = 4 << 20
LEVEL = 3

_HEAD = b"QMTS"
_SHARDS = "part int, shard int, first_doc long, last_doc long, n_docs long, before long, n_ids long, payload binary"
NULL_DOC = -(1 << 63)  # stands for a null doc_id, which sorts first


@dataclass
class Store:
    shards: DataFrame
    dictionary: bytes


def _width(ids: bytes, dtype: str) -> bytes:
    return np.frombuffer(ids, "<u4").astype(dtype).tobytes()


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **kept)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def train_dictionary(docs: DataFrame, dtype: str, tokenizer_file: str = WORD_FILE) -> bytes:
    """A dictionary from about SAMPLE_DOCS documents, picked by hash, with at most SAMPLE_BYTES of each.

    Empty where they are too few or too short to train on; frames then stand alone.
    """
    total = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1 << 20, max(1, int(SAMPLE_DOCS / max(total, 1) * (1 << 20)))))

    def serialise(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer_file)
        for batch in batches:
            yield pd.DataFrame({"ids": [_width(x[: 2 * SAMPLE_BYTES], dtype)[:SAMPLE_BYTES] for x in ids_of(batch["text"])]})

    texts = picked.select(F.coalesce("text", F.lit("")).alias("text"))
    samples = [bytes(r.ids) for r in texts.mapInPandas(serialise, "ids binary").limit(2 * SAMPLE_DOCS).collect()]
    samples = sorted(x for x in samples if len(x) >= 8)
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack(rows: list[tuple[int, int, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    docs, counts, frames = zip(*rows)
    ends = np.cumsum([len(f) for f in frames], dtype="<u8")
    head = _HEAD + np.array([1, width], "<u2").tobytes() + dictionary_hash + np.array([len(docs)], "<u8").tobytes()
    return head + np.array(docs, "<i8").tobytes() + np.array(counts, "<u8").tobytes() + ends.tobytes() + b"".join(frames)


class Shard:
    """Reads a shard's index, and frames one by one."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:4] != _HEAD or payload[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("no shard, or of another dictionary")
        version, width = np.frombuffer(payload[4:8], "<u2").tolist()
        if version != 1:
            raise ValueError(f"version {version}")
        n = int(np.frombuffer(payload[40:48], "<u8")[0])
        self.dtype = f"<u{width}"
        at = 48
        self.docs, self.counts, ends = (np.frombuffer(payload[at + 8 * n * i : at + 8 * n * (i + 1)], t) for i, t in enumerate(("<i8", "<u8", "<u8")))
        self._base = at + 24 * n
        self._ends = np.concatenate([[0], ends.astype(np.int64)])
        self._payload, self._decompress = payload, _decompressor(dictionary).decompress

    def ids(self, i: int) -> np.ndarray:
        """The i-th document's ids; no other frame is touched."""
        frame = self._payload[self._base + self._ends[i] : self._base + self._ends[i + 1]]
        found = np.frombuffer(self._decompress(frame), self.dtype)
        if len(found) != self.counts[i]:
            raise ValueError("a frame doesn't hold what the index says")
        return found


def write(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer_file: str = WORD_FILE, id_bytes: int = 2) -> None:
    """Writes all documents' ids, each with the end id after them, to ``path``, in ascending doc_id order.

    docs: doc_id and text; more columns are ignored, and repeated rows stay. A null or empty text has the
    end id alone; a null doc_id comes first. id_bytes: 2 for vocabularies under 65536, else 4. Texts are dealt
    out by ranges of doc_id before they are encoded, so that they are encoded and shuffled once.
    """
    spark = docs.sparkSession
    dtype = f"<u{id_bytes}"
    dictionary = train_dictionary(docs, dtype, tokenizer_file)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, compress = word_ids(tokenizer_file), _compressor(shared.value).compress
        digest = hashlib.sha256(shared.value).digest()
        part = TaskContext.get().partitionId()
        shard, before, size, rows = 0, 0, 0, []

        def flush() -> pd.DataFrame:
            nonlocal shard, before, size, rows
            n = sum(r[1] for r in rows)
            out = (part, shard, rows[0][0], rows[-1][0], len(rows), before, n, _pack(rows, id_bytes, digest))
            shard, before, size, rows = shard + 1, before + n, 0, []
            return pd.DataFrame([out], columns=[x.split()[0] for x in _SHARDS.split(", ")])

        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.iloc[i : i + 256]
                for doc, ids in zip(some["doc_id"], ids_of(some["text"])):
                    rows.append((doc, len(ids) // 4 + 1, compress(_width(ids + end, dtype))))
                    size += len(rows[-1][2])
                    if size >= SHARD_BYTES:
                        yield flush()
        if rows:
            yield flush()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(encode, _SHARDS).write.option("compression", "none").parquet(f"{path}/shards")


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark.read.schema(_SHARDS).parquet(f"{path}/shards"), bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary))


def documents(store: Store) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the shards.

    A shard knows its start within its part; the parts' sums, a row for each partition of the write, give the rest.
    """
    sums = store.shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_doc").alias("first"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    shared = store.shards.sparkSession.sparkContext.broadcast(store.dictionary)

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, payload in zip(batch["start"], batch["payload"]):
                shard = Shard(payload, shared.value)
                counts = shard.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(len(counts))]
                docs = pd.array(shard.docs, "Int64")
                docs[shard.docs == NULL_DOC] = pd.NA
                yield pd.DataFrame({"doc_id": docs, "start": starts, "n_tokens": counts, "ids_crc32": crc})

    placed = store.shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "payload")
    return placed.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(store: Store, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that id), from the shards whose range holds it."""
    found = store.shards.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).select("payload").collect()
    shards = [Shard(bytes(r.payload), store.dictionary) for r in found]
    return [s.ids(i).tolist() for s in shards for i in np.flatnonzero(s.docs == doc_id)]


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs to a store in the shared folder and returns documents() of it."""
    spark = docs.sparkSession
    path = support.new_path(spark, "token-store")
    write(docs, path)
    return documents(open_store(spark, path))
