"""Quality by supervised subword embeddings.

Words and their character n-grams are hashed to rows of a table of vectors. A document is the mean of the vectors of all
its words and n-grams, repeats counted, and a softmax over the classes is laid on that mean. Vectors and output are learnt together by
stochastic gradient descent over single documents with a falling rate. As output and mean are linear, a word's share
in the scores is added up once per worker and remembered; every text is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import support
from quillmere.llm.toxicity import learnable

#: Labelled documents that train the model, about. Their features, as (bucket, count), are the largest thing that the driver holds.
SAMPLE_DOCS = 6_000
#: Rows of the table of vectors, their length, and the lengths of n-grams.
BUCKETS, DIM, GRAMS = 1 << 15, 12, (2, 3, 4)
#: Features without weight that every mean counts besides, so that a text of a word or two is judged with caution.
PRIOR_FEATURES = 20
EPOCHS, RATE, SEED = 5, 0.5, 11
THRESHOLD = 0.5
CLASSES = 2

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that a worker remembers; longer ones are worked out each time.
REMEMBERED, LONGEST = 150_000, 64
_MIX, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words by white space, with their marks and case; one that repeats its neighbour is '=', whatever it is."""
    words = _WORD.findall(text or "")
    return ["=" if a == b else a for a, b in zip(words, ["", *words])]


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each feature of each word, the number of the word and the feature's row in the table.

    Features are <word> as a whole and its n-grams, each hashed by its code points.
    """
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word, end = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    hashes = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        start = at[at + n <= end]
        found = codes[start] + np.uint64(n)
        for k in range(1, n):
            found = found * _MIX + codes[start + k]
        hashes.append(found)
        owners.append(word[start])
    rows = (np.concatenate(hashes) * _SPREAD) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate(owners), rows.astype(np.int64)


class Shares:
    """What each word adds to the sums over a document: the rows of a table over its features, and their number."""

    def __init__(self, table: np.ndarray):
        self._table = table
        self._known: dict[str, int] = {}
        self._sums = np.zeros((0, table.shape[1] + 1))

    def _of(self, words: list[str]) -> np.ndarray:
        owner, rows = features_of(words)
        n = len(words)
        return np.stack([*(np.bincount(owner, self._table[rows, k], n) for k in range(self._table.shape[1])), np.bincount(owner, minlength=n)], axis=1)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sums over all its words, with the number of its features last."""
        known, split = self._known, [words_of(t) for t in texts]
        new = {w for words in split for w in words if w not in known and len(w) <= LONGEST}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            self._sums = self._sums[:0]
            new = {w for words in split for w in words if len(w) <= LONGEST}
        if new:
            order = sorted(new)
            for w in order:
                known[w] = len(known)
            self._sums = np.concatenate([self._sums, *(self._of(order[i : i + 5000]) for i in range(0, len(order), 5000))])
        out = np.zeros((len(texts), self._table.shape[1] + 1))
        for i, words in enumerate(split):
            places = [known[w] for w in words if len(w) <= LONGEST]
            out[i] = self._sums[places].sum(axis=0)
            for w in words:
                if len(w) > LONGEST:
                    out[i] += self._of([w])[0]
        return out


@dataclass
class Model:
    """The output for each bucket's vector, and that for a document without features."""

    logits: np.ndarray  # BUCKETS x CLASSES
    prior: np.ndarray  # CLASSES

    def scorer(self):
        shares, prior = Shares(self.logits), self.prior

        def score(texts: list[str | None]) -> np.ndarray:
            found = shares.totals(texts)
            z = prior + found[:, :-1] / (found[:, -1:] + PRIOR_FEATURES)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e[:, 1] / e.sum(axis=1)

        return score


def counts_of(text: str | None) -> np.ndarray:
    """How often each row of the table is a feature of the text."""
    words = Counter(words_of(text))
    out, every = np.zeros(BUCKETS), list(words)
    for i in range(0, len(every), 5000):
        some = every[i : i + 5000]
        owner, rows = features_of(some)
        out += np.bincount(rows, np.array([words[w] for w in some], float)[owner], BUCKETS)
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Vectors and output from documents as (buckets, counts) and their classes.

    The output starts at zero but for the bias of the smoothed base rate; with fewer than two classes nothing is learnt.
    """
    count = np.bincount(labels, minlength=CLASSES).astype(float)
    bias = np.log((count + 0.5) / (count.sum() + 0.5 * CLASSES))
    bias -= bias.mean()
    prior = bias.copy()
    if (count > 0).sum() < 2:
        return Model(np.zeros((BUCKETS, CLASSES)), prior)
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output = np.zeros((DIM, CLASSES))
    step, steps = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in random.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            rows, times = docs[i]
            if not len(rows):
                continue
            share = times / (times.sum() + PRIOR_FEATURES)
            hidden = share @ vectors[rows]
            z = hidden @ output + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[labels[i]] -= 1.0
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # The mean spreads a document's gradient over its features; they take it whole, as the vectors' rate.
            vectors[rows] -= np.outer(share * (rate * len(rows) / 8), back)
    return Model(vectors @ output, bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on documents that labels (doc_id, quality: 0 or 1, others are ignored) cover and that aren't held out.

    About SAMPLE_DOCS of them take part, picked by a hash of doc_id. Their features are counted in tasks; the driver
    gets the counts of at most BUCKETS buckets a document.
    """
    one = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    one = one.where(learnable(F.col("doc_id")))
    share = min(1 << 20, max(1, int(SAMPLE_DOCS / max(one.count(), 1) * (1 << 20))))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(picked).join(one.where(picked), "doc_id").select("doc_id", "text", "quality")

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, times = [], []
            for text in batch["text"]:
                found = counts_of(text)
                rows.append(np.flatnonzero(found).astype("<i4").tobytes())
                times.append(found[found > 0].astype("<i4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "rows": rows, "times": times})

    # Bounded: about SAMPLE_DOCS rows. Sorted, so that the order of steps doesn't depend on that of tasks.
    data = sample.mapInPandas(counted, "doc_id long, quality int, rows binary, times binary").toArrow().sort_by([("doc_id", "ascending"), ("rows", "ascending")])
    pairs = [(np.frombuffer(r.as_buffer(), "<i4"), np.frombuffer(t.as_buffer(), "<i4")) for r, t in zip(data["rows"], data["times"])]
    return fit(pairs, np.array(data["quality"].to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score and predicted of every row; only the text decides. Null and empty texts score as the bias does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x CLASSES numbers

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value = shared.value.scorer()
        for some in texts:
            yield pd.Series(np.concatenate([np.empty(0), *(value(some.iloc[i : i + 64].tolist()) for i in range(0, len(some), 64))]))

    scored = docs.select(*keep, of(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; further columns are left out.

    labels: doc_id and quality. Where a document has several, the largest counts. Only documents that aren't held out are learnt
    from. Repeated rows are scored each; without usable labels every score is the smoothed base rate, 0.5 if there are none at all.
    """
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
