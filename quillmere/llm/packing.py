"""Best-fit packing of token pieces into fixed-length sequences, planned on the histogram of lengths.

A plan says how many sequences hold which combination of lengths. It depends on the histogram alone,
which has at most one entry for each length, so it is made on the driver in bounded memory; pieces
then find their places by their rank among those of equal length, in parallel.

Combinations come from exact-complement hashing: tables that are looked up by a sum hold how many single lengths,
pairs and triples of available lengths have it. The gap that a length leaves is looked up in them, a combination with exactly
that sum is read off by looking up what each of its lengths leaves, and it is used as many times as all its lengths are available. What no combination fills is placed best-fit:
longest first, into the smallest gap that takes it.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm import support
from quillmere.llm.tokens import WORD_FILE, word_ids

CAPACITY = 2048
END_ID = 0
#: Rows of equal length that one task ranks, about.
RANKED_ROWS = 200_000
#: Parts of each length at least.
SALTS = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_file: str = WORD_FILE) -> DataFrame:
    """Cuts each document's ids, and the end id after them, into pieces of at most ``capacity``.

    docs: doc_id and text; more columns are ignored, and repeated rows give repeated pieces. A null or
    empty text gives one piece that holds the end id alone. Returns doc_id, piece (from 0), start (the
    document's ids before it), length and ids_crc32 (of little-endian 32-bit ids).
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer_file)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], ids_of(batch["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32"})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, PIECES)


class _Sums:
    """How many pieces of each length are left, with the number of available lengths and of ordered pairs and triples of them by their sum."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for n, count in histogram.items():
            self.left[n] = count
        self.have = self.left > 0
        self.pairs, self.triples = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        lengths = np.flatnonzero(self.have)
        for a in lengths:
            self.pairs[a:] += self.have[: capacity + 1 - a]
        for a in lengths:
            self.triples[a:] += self.pairs[: capacity + 1 - a]

    def take(self, lengths: Iterable[int], times: int) -> None:
        size = len(self.left)
        for n, c in Counter(lengths).items():
            self.left[n] -= c * times
            if not self.left[n]:
                # Combinations with n go: those with it at each place, less what that counts twice, and so on.
                self.triples[n:] -= 3 * self.pairs[: size - n]
                self.pairs[n:] -= 2 * self.have[: size - n]
                if 2 * n < size:
                    self.triples[2 * n :] += 3 * self.have[: size - 2 * n]
                    self.pairs[2 * n] += 1
                if 3 * n < size:
                    self.triples[3 * n] -= 1
                self.have[n] = False

    def _fits(self, used: Counter[int], *lengths: int) -> bool:
        need = used + Counter(lengths)
        return all(self.left[k] >= c for k, c in need.items())

    def exact(self, anchor: int, gap: int) -> tuple[int, ...]:
        """One, two or three lengths, the longest first, that with the anchor are available and sum to gap."""
        used = Counter((anchor,))
        if self.have[gap] and self._fits(used, gap):
            return (gap,)
        if found := self._pair(gap, used, gap):
            return found
        if not self.triples[gap]:
            return ()
        firsts = np.flatnonzero(self.have[: gap + 1] & (self.pairs[gap::-1] > 0))
        for a in firsts[::-1].tolist():
            if found := self._pair(gap - a, used + Counter((a,)), a):
                return (a, *found)
        return ()

    def _pair(self, total: int, used: Counter[int], most: int) -> tuple[int, ...]:
        if total < 2 or not self.pairs[total]:
            return ()
        low = (total + 1) // 2
        both = np.flatnonzero(self.have[low : total + 1] & self.have[total - low :: -1][: total + 1 - low]) + low
        for a in both[both <= most][::-1].tolist():
            if self._fits(used, a, total - a):
                return (a, total - a)
        return ()


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a sequence, and how many sequences have each.

    histogram: how many pieces have each length, 1 to ``capacity``. Every piece is placed, no pattern
    is longer than ``capacity``, and equal histograms give equal plans.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths have to be from 1 to the capacity")
    sums = _Sums(histogram, capacity)
    left = sums.left
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        sums.take((capacity,), int(left[capacity]))
    for n in range(capacity - 1, 0, -1):
        while left[n] and (fill := sums.exact(n, capacity - n)):
            times = min(int(left[k]) // c for k, c in Counter((n, *fill)).items())
            done.append(((n, *fill), times))
            sums.take((n, *fill), times)
    # What is left goes best-fit, longest first; bins of one pattern are handled together.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def add(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append((pattern, times))

    for n in range(capacity - 1, 0, -1):
        todo = int(left[n])
        while todo:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):
                per = capacity // n  # new sequences, of this length alone
                if whole := todo // per:
                    add((n,) * per, whole)
                if todo % per:
                    add((n,) * (todo % per), 1)
                break
            gap = gaps[i]
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(i)
            fit = gap // n
            if full := min(times, todo // fit):
                add(pattern + (n,) * fit, full)
                times, todo = times - full, todo - full * fit
            if times and todo:  # fewer are left than one sequence takes
                add(pattern + (n,) * todo, 1)
                times, todo = times - 1, 0
            if times:
                add(pattern, times)
    return done + [x for gap in gaps for x in open_[gap]]


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be a table, as it is read more than once.

    A piece's rank among those of its length picks its slot. Ranks are taken within salted parts of each
    length and made whole by the parts' counts, so that one length may hold any share of the pieces.
    """
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(SALTS, max(histogram.values(), default=0) // RANKED_ROWS + 1)
    slots = defaultdict(list)  # of each length: first rank, sequence less rank, offset
    base = 0
    taken: Counter[int] = Counter()
    for pattern, times in plan(histogram, capacity):
        at = 0
        for n in pattern:
            slots[n].append((taken[n], base - taken[n], at))
            taken[n] += times
            at += n
        base += times
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        salted.withColumn("r", rank)
        .join(before, ["length", "salt"])  # dealt out by the window's keys already
        .withColumn("r", F.col("r") - 1 + F.col("before"))
    )
    # Its size is that of the plan: some slots for each of at most capacity lengths, however many pieces there are.
    tables = spark.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in slots.items()})

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def slot(length: pd.Series, r: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), r.to_numpy()
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for n in np.unique(lengths):
            own = lengths == n
            first, shift, at = tables.value[int(n)]
            k = np.searchsorted(first, ranks[own], "right") - 1
            sequence[own], offset[own] = ranks[own] + shift[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", slot("length", "r").alias("s")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "s.sequence_id", "s.offset"
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_file: str = WORD_FILE) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids; see pieces() and place().

    An empty table gives no rows; a null doc_id is kept as null.
    """
    return place(support.materialise(pieces(docs, capacity, end_id, tokenizer_file), "pieces"), capacity)
