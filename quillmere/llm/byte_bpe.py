"""Byte-level BPE by a queue of merge ranks: a hierarchical bitmap over buckets of positions.

A piece is a linked list of byte spans. Each pair of neighbours whose union is a token waits in the
bucket of that token's rank; a two-level bitmap of 256-bit words knows which buckets hold something, so that
find-first-set on two words gives the lowest rank. Within a bucket the leftmost position comes first,
and entries whose pair has changed since are skipped. A merge costs the same in a piece of any
length, so that a piece of a million bytes takes time in proportion to its length (and the logarithm of a bucket).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class ByteBpe:
    """Encodes and decodes with the ranks of a .tiktoken file, as the tiktoken library's encode_ordinary does."""

    def __init__(self, path: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self._low = [0] * ((max(self.ranks.values()) >> 8) + 1)  # a bit for each rank, empty between calls
        self._buckets: dict[int, list[int]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        get, low, buckets = ranks.get, self._low, self._buckets
        after = list(range(1, n + 2))  # where the span that begins here ends, and the next begins
        before = list(range(-1, n))
        pair: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)] + [None, None]
        top = 0  # a bit for each word of low
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            b = (top & -top).bit_length() - 1
            w = low[b]
            r = b << 8 | ((w & -w).bit_length() - 1)
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[b] = w = w & (w - 1)
                if not w:
                    top &= top - 1
            if pair[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = None
            if k <= n:
                before[k] = i
            p = before[i]
            new = pair[i] = get(piece[i : after[k]]) if k < n else None
            if new is not None:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    low[new >> 8] |= 1 << (new & 255)
                    top |= 1 << (new >> 8)
            if p >= 0:
                new = pair[p] = get(piece[p:k])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], p)
                    else:
                        buckets[new] = [p]
                        low[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.encode_piece(piece.encode("utf-8"))]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Digests:
    """Digests of encoded and decoded texts; each distinct piece is encoded and decoded once while remembered."""

    def __init__(self, bpe: ByteBpe, limit: int = 1_200_000):
        self._bpe, self._limit = bpe, limit
        self._decimal = {i: b"%d" % i for i in bpe.tokens}
        self._ids: dict[str, bytes] = {}  # decimal ids, joined by commas
        self._back: dict[str, bytes] = {}

    def __call__(self, text: str) -> tuple[int, str, str]:
        pieces = self._bpe.pieces(text)
        if len(self._ids) > self._limit:
            self._ids.clear()
            self._back.clear()
        encode, decimal, token = self._bpe.encode_piece, self._decimal.__getitem__, self._bpe.tokens.__getitem__
        known = self._ids
        for piece in {x for x in pieces if x not in known}:
            ids = encode(piece.encode("utf-8"))
            self._ids[piece] = b",".join(map(decimal, ids))
            self._back[piece] = b"".join(map(token, ids))
        ids = b",".join(map(self._ids.__getitem__, pieces))
        back = b"".join(map(self._back.__getitem__, pieces))
        return ids.count(b",") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


_of_worker: dict[tuple[str, str], _Digests] = {}


def _digests(rank_file: str, pattern: str) -> _Digests:
    """This Python process's _Digests; tasks that a worker runs one after another share it.

    A function of the module, as tasks get those by name: what a task's own function names is copied into each task.
    """
    if (rank_file, pattern) not in _of_worker:
        _of_worker[rank_file, pattern] = _Digests(ByteBpe(rank_file, pattern))
    return _of_worker[rank_file, pattern]


def encode_decode(docs: DataFrame, rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded bytes) of every row.

    docs: doc_id and text; more columns are ignored, repeated rows stay. Null and empty texts have no
    tokens, and the digests of nothing. Nothing is shuffled; a text of any length stays in its row.
    """

    def digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = _digests(rank_file, pattern)
        for batch in batches:
            n, ids, decoded = zip(*map(of, batch["text"])) if len(batch) else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encoded(docs: DataFrame, rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array<int>) of every row; texts as in encode_decode()."""

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(rank_file, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(encode, "doc_id long, ids array<int>")
