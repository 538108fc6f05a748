"""Toxicity by a linear classifier that is regularised with counterfactual sentences.

Features are the distinct words of a text and their beginnings of 3 to 6 letters. In labelled texts that
name a group of people, the name is swapped for another of the same kind, and training penalises the squared change
of the log-odds, so that naming a group moves no score by itself. Weights are fitted on a bounded sample of
labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm import support, tokens

#: Labelled documents that train the classifier, about, and features that it may weigh.
SAMPLE_DOCS, FEATURES = 16_000, 4_096
#: Evidence that a feature needs: its distance from the base rate in standard deviations.
EVIDENCE = 4.0
RIDGE, FAIRNESS, STEPS = 5e-5, 1.0, 600
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6)

#: Names of groups, of a kind in each line; any may stand for the others of its line.
IDENTITIES = """
women men girls boys
woman man girl boy
female male
mothers fathers
muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists
black white asian latino arab
gay lesbian straight bisexual
transgender cisgender
immigrants refugees foreigners natives
german french spanish american african european
old young
disabled blind deaf
frauen männer mädchen jungen
frau mann
muslime christen juden
ausländer flüchtlinge einheimische
femmes hommes filles garçons
femme homme
musulmans chrétiens juifs
étrangers réfugiés immigrés
mujeres hombres niñas niños
mujer hombre
musulmanes cristianos judíos
extranjeros refugiados inmigrantes
"""
SWAPS = {
    word: kind[(i + 1) % len(kind)] for kind in (line.split() for line in IDENTITIES.strip().split("\n")) for i, word in enumerate(kind)
}

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings, which end in a hyphen. A name of a group is one feature only."""
    return [word] if word in SWAPS else [word, *(word[:n] + "-" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Weights of features; the log-odds of a text are the bias and the weights of its distinct features."""

    bias: float
    weights: dict[str, float]

    def scorer(self):
        seen: dict[str, tuple[str, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            if len(seen) > 60_000:
                seen.clear()
            found: set[str] = set()
            for word in words_of(text):
                own = seen.get(word)
                if own is None:
                    own = seen[word] = tuple(f for f in features_of(word) if f in weights)
                if own:
                    found.update(own)
            z = bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit(rows: list[tuple[list[int], list[int] | None, int]], n_features: int) -> tuple[float, np.ndarray]:
    """solve() on rows of (features, features after swapping or None, label)."""
    found = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.array([i for r in rows for i in r[0]], np.int64)
    return solve(*found, np.array([r[2] for r in rows], float), [(r[0], r[1]) for r in rows if r[1] is not None], n_features)


def solve(row: np.ndarray, col: np.ndarray, y: np.ndarray, swapped: list[tuple[list[int], list[int]]], n_features: int) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated gradient steps, from the features col of each row, labels y, and pairs of features before and after swapping.

    Without both labels the weights are zero and the bias is that of the smoothed base rate.
    """
    base = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(base / (1 - base)))
    if len(y) == 0 or y.min() == y.max() or not n_features:
        return start, np.zeros(n_features)

    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    both = [(set(x) - set(z), set(z) - set(x)) for x, z in swapped]
    # The change of the log-odds is linear in the weights: +1 for features that swapping brings, -1 for those it takes away.
    c_row, c_col = sparse([sorted(a) + sorted(b) for a, b in both])
    c_val = np.array([v for a, b in both for v in [-1.0] * len(a) + [1.0] * len(b)])
    w, b, n, m = np.zeros(n_features), start, len(y), max(1, len(both))
    v, vb = w.copy(), b
    # Steps of one over the largest curvature, found by power iteration over the weights and the bias, can't diverge.
    x, xb, curvature = np.random.default_rng(0).normal(size=n_features), 1.0, 1.0
    for _ in range(30):
        z = (xb + np.bincount(row, x[col], n)) / (4 * n)
        y_, yb = np.bincount(col, z[row], n_features) + RIDGE * x, z.sum()
        if len(both):
            change = np.bincount(c_row, c_val * x[c_col], len(both))
            y_ = y_ + FAIRNESS * np.bincount(c_col, c_val * change[c_row], n_features) / m
        curvature = float(np.sqrt(y_ @ y_ + yb * yb) / max(np.sqrt(x @ x + xb * xb), 1e-300))
        scale = max(float(np.sqrt(y_ @ y_ + yb * yb)), 1e-300)
        x, xb = y_ / scale, yb / scale
    rate = 1 / (1.2 * curvature)
    for step in range(STEPS):
        z = b + np.bincount(row, w[col], n)
        error = (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(col, error[row], n_features) + RIDGE * w
        if len(both):
            change = np.bincount(c_row, c_val * w[c_col], len(both))
            grad += FAIRNESS * np.bincount(c_col, c_val * change[c_row], n_features) / m
        new, new_b = w - rate * grad, b - rate * error.sum()
        momentum = step / (step + 3)
        w, b, v, vb = new + momentum * (new - v), new_b + momentum * (new_b - vb), new, new_b
    return float(b), v


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the documents that labels (doc_id, toxic: 0 or 1, others are ignored) cover and that aren't held out.

    About SAMPLE_DOCS documents take part, picked by a hash of doc_id. Features are those whose share of toxic documents differs from the
    base rate by EVIDENCE standard deviations, counted in the sample, and all names of groups; at most FEATURES of them.
    """
    one = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    one = one.where(learnable(F.col("doc_id")))
    share = min(1 << 20, max(1, int(SAMPLE_DOCS / max(one.count(), 1) * (1 << 20))))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(picked).join(one.where(picked), "doc_id").select("doc_id", "text", "toxic")

    def featured(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        for batch in batches:
            for i in range(0, len(batch), 200):
                some, found, swapped = batch.iloc[i : i + 200], [], []
                for text in some["text"]:
                    words = words_of(text)
                    found.append(sorted({f for w in words for f in features_of(w)}))
                    named = words & SWAPS.keys()
                    swapped.append(sorted({f for w in words for f in features_of(SWAPS.get(w, w))}) if named else None)
                yield pd.DataFrame({"doc_id": some["doc_id"], "toxic": some["toxic"], "found": found, "swapped": swapped})

    table = support.materialise(sample.mapInPandas(featured, "doc_id long, toxic int, found array<string>, swapped array<string>"), "features", "snappy")
    n, positive = table.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    p = positive / n if n else 0.0
    counts = table.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("df"), F.sum("toxic").alias("t")).where("df >= 4")
    z = F.abs(F.col("t") - F.col("df") * p) / F.sqrt(F.col("df") * max(p * (1 - p), 1e-9))
    chosen = counts.select("f", z.alias("z")).where(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "f").limit(FEATURES)
    names = sorted({r.f for r in chosen.collect()} | SWAPS.keys())
    index = table.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # at most FEATURES and the names

    def indexed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = index.value
        for batch in batches:
            keep = lambda x: None if x is None else [of[f] for f in x if f in of]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "found": batch["found"].map(keep), "swapped": batch["swapped"].map(keep), "toxic": batch["toxic"]})

    # Bounded: about SAMPLE_DOCS rows of chosen features, as Arrow arrays.
    data = table.mapInPandas(indexed, "doc_id long, found array<int>, swapped array<int>, toxic int").orderBy("doc_id", "found").toArrow()
    found, swapped = data["found"], data["swapped"]
    size = np.array([len(x) for chunk in found.chunks for x in chunk], np.int64)
    col = np.concatenate([np.empty(0, np.int64), *(chunk.flatten().to_numpy(zero_copy_only=False) for chunk in found.chunks)]).astype(np.int64)
    named = [(found[int(i)].as_py(), swapped[int(i)].as_py()) for i in np.flatnonzero(swapped.is_valid().to_numpy())]
    bias, weights = solve(np.repeat(np.arange(len(size)), size), col, np.array(data["toxic"].to_pylist(), float), named, len(names))
    return Model(bias, {f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-6})


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: those that are not held out."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score and predicted of every row; only the text decides. Null and empty texts score as the bias does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights and the names of groups

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens.release()
        value = shared.value.scorer()
        for some in texts:
            yield some.map(value).astype(float)

    scored = docs.select(*keep, of(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    labels: doc_id and toxic. Where a document has several, the largest counts. Only documents that aren't held out are learnt
    from. Repeated rows are scored each; without usable labels every score is the smoothed base rate, 0.5 if there are none at all.
    """
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")

