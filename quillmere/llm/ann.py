"""Nearest neighbours by inner product: an inverted file of coarse cells with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed. A query looks at
the cells whose centroids promise most, sums asymmetric distance tables over the codes in them, and takes the exact
inner product, on the original vectors, of the best, and of all whose codes' error leaves them a chance. How many cells it looks at, and whether centroids are ranked by inner product or by
distance, is measured on some of the queries, against brute force over all vectors: clustered vectors need few cells, isotropic ones many, and queries unlike the vectors more. The first cells give each query
a bound, and of the other cells only what reaches it leaves its task. Equal vectors are indexed once, with the smallest of their ids, more than any result can hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm import support

SAMPLE = 20_000  # vectors that centroids and codebooks are fitted on
PARTS, CODES = 16, 256
MOST_CELLS = 4_096
TRIED = 300  # queries that the number of cells is measured on
RECALL = 0.97  # of brute force for these queries, which the number of cells looked at has to reach
CERTAIN = 0.999  # of codes, whose error is within what is allowed for
FIRST = 4  # cells that are looked at before the others, for a bound that their vectors have to reach
RERANKED = 10  # times k codes whose exact product is taken at least, in each block of a cell
BLOCK, QUERY_BLOCK = 8_192, 4_096
SALTS = 64


@dataclass
class Codec:
    cells: np.ndarray  # cells x dimensions
    books: np.ndarray  # parts x codes x width
    probes: int
    less: np.ndarray  # what each centroid's inner product is lowered by, to rank cells
    slack: float = 1.0  # how much of (length of query) x (length of what a code leaves out) a code's product may be below the exact one

    def promised(self, q: np.ndarray) -> np.ndarray:
        return self.cells @ q - self.less

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def parts(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.books.shape[0] * self.width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.books.shape[0], self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.cells)
        rest = self.parts(x - self.cells[cell])
        return cell, np.stack([_nearest(rest[:, j], self.books[j]) for j in range(len(self.books))], 1).astype(np.uint8)

    def lost(self, x: np.ndarray, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What codes leave out of their vectors."""
        return self.parts(x - self.cells[cell]).reshape(len(x), -1) - self.books[np.arange(code.shape[1]), code].reshape(len(x), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's parts with all codes."""
        return np.einsum("jw,jcw->jc", self.parts(q[None])[0], self.books)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        own = _nearest(x, centroids)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], 1)
        full = count > 0
        centroids[full] = sums[full] / count[full, None]
        if (~full).any():
            centroids[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centroids


def fit(sample: np.ndarray, total: int) -> Codec:
    """Cells and codebooks, from sampled vectors of a table with ``total`` of them. Such a codec looks at all cells."""
    rng = np.random.default_rng(0)
    sample = sample[np.lexsort(sample.T[::-1])]
    n_cells = int(max(1, min(MOST_CELLS, 2 * np.sqrt(total), len(sample) // 8)))
    cells = _kmeans(sample, n_cells, rng)
    own = _nearest(sample, cells)
    width = -(-sample.shape[1] // PARTS)
    codec = Codec(cells, np.zeros((PARTS, CODES, width)), n_cells, np.zeros(n_cells))
    rest = codec.parts(sample - cells[own])
    codec.books = np.stack([_kmeans(rest[:, j], CODES, rng, 8) for j in range(PARTS)])
    return codec


def measure(codec: Codec, sample: np.ndarray, queries: np.ndarray, at: np.ndarray, cell: np.ndarray) -> None:
    """Sets how many cells are looked at, in which order, and what is allowed for the error of codes.

    queries: some of those that will be asked. at, cell: for each of their true neighbours among all vectors, the query's place in queries and the neighbour's cell.
    """
    for less in (np.zeros(len(codec.cells)), (codec.cells**2).sum(1) / 2):
        order = np.argsort(np.argsort(-(queries @ codec.cells.T - less), axis=1, kind="stable"), axis=1)
        probes = int(min(len(codec.cells), np.quantile(order[at, cell], RECALL, method="higher") + 1)) if len(at) else len(codec.cells)
        if probes < codec.probes:
            codec.probes, codec.less = probes, less
    lost = codec.lost(sample, *codec.encode(sample))
    length = np.linalg.norm(lost, axis=1)
    width = lost.shape[1]
    padded = np.zeros((len(queries), width))
    padded[:, : queries.shape[1]] = queries / np.linalg.norm(queries, axis=1)[:, None]
    some = lost[length > 0] / length[length > 0, None]
    codec.slack = max(0.0, float(np.quantile(padded @ some.T, CERTAIN))) if len(some) else 0.0


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part: not null, not zero, all components finite.

    Where lengths differ, the most common one takes part (of equally common ones the longest).
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    )
    sizes = some.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return some.where(F.size("v") == (sizes[0].d if sizes else 0))


def _true_cells(index: DataFrame, ids: list[int], queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the k nearest entries of some queries, by brute force over all entries, the query's place and the entry's cell."""
    asked = index.sparkSession.sparkContext.broadcast((np.array(ids), queries))

    def nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = asked.value
        score, cell = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for batch in batches:
            if len(batch):
                products = q @ np.stack(batch["v"].to_numpy()).T
                only = np.array([x[0] if len(x) == 1 else -1 for x in batch["ids"]])
                alone = np.array([len(x) == 1 for x in batch["ids"]])
                products[(ids[:, None] == only) & alone] = -np.inf  # a query is no neighbour of itself
                score = np.concatenate([score, products], axis=1)
                cell = np.concatenate([cell, np.broadcast_to(batch["cell"].to_numpy(), products.shape)], axis=1)
                if score.shape[1] > k:
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, cell = np.take_along_axis(score, best, axis=1), np.take_along_axis(cell, best, axis=1)
        place = np.repeat(np.arange(len(q)), score.shape[1])
        found = pd.DataFrame({"place": place, "score": score.ravel(), "cell": cell.ravel()})
        yield found[found["score"] > -np.inf]

    found = index.select("cell", "ids", "v").mapInPandas(nearest, "place int, score double, cell int")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "cell"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("place", "cell").collect()  # TRIED x k rows
    return np.array([r.place for r in best], int), np.array([r.cell for r in best], int)


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: for each vec_id divisible by ``every`` the k nearest other rows found.

    vectors: vec_id and embedding; more columns are ignored. Nearness is the inner product in double
    precision, ties go to the smaller vec_id. A vec_id that repeats counts once for each distinct vector that it has. Without vectors there are no rows.
    """
    spark = vectors.sparkSession
    rows = support.materialise(valid(vectors), "vectors")
    # Equal vectors become one entry with their k + 1 smallest ids, first within salted parts of a vector's rows.
    smallest = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    salted = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(smallest(F.collect_list("vec_id")).alias("ids"))
    entries = support.materialise(salted.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids")), "entries")
    total = entries.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    picked = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < min(1 << 20, int(SAMPLE / total * (1 << 20)) + 1)
    sample = np.array([r.v for r in entries.where(picked).select("v").limit(2 * SAMPLE).collect()])
    coded = fit(sample, total)
    codec = spark.sparkContext.broadcast(coded)  # at most MOST_CELLS centroids and the codebooks

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, code = codec.value.encode(np.stack(batch["v"].to_numpy()))
                lost = np.linalg.norm(codec.value.lost(np.stack(batch["v"].to_numpy()), cell, code), axis=1)
                yield pd.DataFrame({"cell": cell, "ids": batch["ids"], "v": batch["v"], "code": [c.tobytes() for c in code], "lost": lost})

    index = support.materialise(entries.mapInPandas(encode, "cell int, ids array<long>, v array<double>, code binary, lost double"), "index")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    tried = asking.orderBy(F.xxhash64("query_id"), "query_id", F.xxhash64("q")).limit(TRIED).collect()
    if not tried:
        return spark.createDataFrame([], empty)
    queries = np.array([r.q for r in tried])
    measure(coded, sample, queries, *_true_cells(index, [r.query_id for r in tried], queries, k))
    codec = spark.sparkContext.broadcast(coded)
    sizes = {r.cell: (r.n, r.m) for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")).collect()}
    known = spark.sparkContext.broadcast(sizes)  # a row for each cell

    @F.pandas_udf("array<int>")
    def looked_at(v: pd.Series) -> pd.Series:
        probes = codec.value.probes
        filled = np.array([known.value.get(c, (0, 0))[1] for c in range(len(codec.value.cells))])
        out = []
        for q in v:
            order = np.argsort(-codec.value.promised(q), kind="stable")
            enough = int(np.searchsorted(np.cumsum(filled[order]), 4 * k + 1)) + 1  # cells until there are candidates enough
            out.append([int(c) for c in order[: max(probes, enough)] if filled[c]])
        return pd.Series(out)

    asked = support.materialise(asking.select("query_id", "q", F.posexplode(looked_at("q")).alias("place", "cell")), "asked")
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_parts"))
    blocks = {c: -(-n // BLOCK) for c, (n, _) in sizes.items()}
    block_table = spark.createDataFrame(sorted(blocks.items()), "cell int, blocks int").join(parts, "cell")
    block_table = F.broadcast(support.materialise(block_table, "blocks"))  # a row for each cell

    def dealt(some: DataFrame) -> DataFrame:
        return (
            some.join(block_table, "cell").withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "q_part", "query_id", "q", "bound")
        )

    right = (
        index.join(block_table, "cell")
        .withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    )

    def look(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            of = codec.value
            v = np.stack(held["v"].to_numpy())
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
            flat = codes.astype(np.int64) + np.arange(codes.shape[1]) * CODES
            ids, lost = held["ids"].to_numpy(), held["lost"].to_numpy()
            first = np.array([x[0] for x in ids])
            cell = of.cells[int(held["cell"].iloc[0])]
            for query, q, bound in zip(queries["query_id"], queries["q"], queries["bound"]):
                near = cell @ q + of.tables(q).ravel()[flat].sum(axis=1)
                some = np.lexsort((first, -near))[: RERANKED * k] if len(near) <= RERANKED * k else np.argpartition(-near, RERANKED * k)[: RERANKED * k]
                exact = (v[some] * q).sum(axis=1)
                if len(near) > len(some):  # of the others, all whose codes may hide a product as good as the best k so far
                    reached = max(bound, np.partition(exact, -k - 1)[-k - 1])
                    maybe = near + of.slack * np.linalg.norm(q) * lost >= reached
                    maybe[some] = False
                    more = np.flatnonzero(maybe)
                    some, exact = np.concatenate([some, more]), np.concatenate([exact, (v[more] * q).sum(axis=1)])
                best, kept = np.lexsort((first[some], -exact)), 0
                for i in best:
                    if exact[i] < bound:
                        break
                    own = [x for x in ids[some[i]] if x != query]
                    out += [(query, x, exact[i]) for x in own]
                    kept += len(own)
                    if kept >= k and (i == best[-1] or exact[best[np.flatnonzero(best == i)[0] + 1]] < exact[i]):
                        break
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ["cell", "block", "q_part"]
    held = right.select(*key, "ids", "v", "code", "lost")

    def looked(some: DataFrame) -> DataFrame:
        return dealt(some).groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(look, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)
    nothing = F.lit(float("-inf"))
    first = support.materialise(best(looked(asked.where(F.col("place") < FIRST).withColumn("bound", nothing))), "first")
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    later = asked.where(F.col("place") >= FIRST).join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", nothing))
    found = first.select("query_id", "vec_id", "score").unionByName(looked(later))
    return best(found).select("query_id", "rank", "vec_id", "score")
