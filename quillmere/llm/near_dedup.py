"""Near-duplicate documents by chosen-path similarity joins on word shingles.

Each tree branches a document from its root: a node picks, by its own hash, BRANCHES of the document's
minwise values and sends it to one child for each, so that documents meet in a child as often as
they are similar. Branching starts with DEPTH levels at once and goes on wherever a node is still large, unless its classes are much alike. The classes
of a small node are compared exhaustively by sketches, and what agrees enough is confirmed on full shingle sets. Independent
trees are repeated until the expected share of pairs at the threshold that meet in no node of the deepest level falls below MISS.

Equal sets are one class from the start. Where a node has many candidates, as in a group of near copies, each class first
names one of them; classes that this connects aren't compared again, and what stays apart is compared
on full sets, in tiles of at most BLOCK by BLOCK classes. So a group of thousands of copies costs little more than its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm import support, tokens

COORDINATES = 128  # minwise values of a document
BRANCHES = 2
DEPTH = 3
MISS = 1e-4
#: A node with more classes is branched further, for as many levels; what is large even then is compared in tiles.
LARGE, MORE_LEVELS, BLOCK = 1024, 6, 512
#: A large node isn't branched if at least this share of its classes agree with its leader.
DENSE = 0.05
#: Sketches may agree by so many standard deviations less than the threshold asks; 3e-5 of the pairs at the threshold fall below, besides MISS.
DEVIATIONS = 4
#: Document ids that may be broadcast, to read the texts of candidates without shuffling all others; of more, the texts are shuffled.
BROADCAST_IDS = 250_000

_MULTIPLIERS = np.random.default_rng(20_240_607).integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_POSITIONS = np.random.default_rng(77).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Shingles:
    """Sorted 64-bit hashes of the distinct k-word shingles of texts.

    Words are runs of anything but blanks (space, tab to carriage return) after lower-casing A-Z. With fewer than
    k words all of them are the one shingle; without words the set is empty.
    """

    def __init__(self, k: int, limit: int = 60_000):
        self.k, self._limit, self._known = k, limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self._known
        if len(known) > self._limit:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - k + 1, k, np.uint64)
            for i in range(k):
                out = _mix(out + h[i : len(words) - k + 1 + i] * _POSITIONS[i % 64])
        return np.unique(out)


def minwise(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 4096):
            best = np.minimum(best, (hashes[i : i + 4096, None] * _MULTIPLIERS).min(axis=0))
    return best


def trees_for(threshold: float, miss: float = MISS) -> int:
    """Trees that leave at most ``miss`` of the pairs at the threshold without a common node at the deepest level."""
    apart = 0.0
    for _ in range(DEPTH + MORE_LEVELS):
        apart = (1 - threshold * (1 - apart)) ** BRANCHES
    return max(1, math.ceil(math.log(miss) / math.log(apart)))


def _children(nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each row's nodes, the children that the row's minwise values lead to."""
    rows = np.arange(len(values))[:, None]
    first = (nodes % np.uint64(COORDINATES)).astype(np.int64)
    step = 1 + ((nodes >> np.uint64(32)) % np.uint64(COORDINATES - 1)).astype(np.int64)
    out = []
    for b in range(BRANCHES):
        pick = (first + b * step) % COORDINATES
        with np.errstate(over="ignore"):
            out.append(_mix(_mix(nodes + np.uint64(b + 1)) + values[rows, pick]))
    return np.concatenate(out, axis=1)


def leaves(values: np.ndarray, trees: int) -> np.ndarray:
    """Each row's nodes at DEPTH in all trees; values has a row of minwise values for each document."""
    nodes = np.tile(_mix(np.arange(1, trees + 1, dtype=np.uint64)), (len(values), 1))
    for _ in range(DEPTH):
        nodes = _children(nodes, values)
    return nodes


def described(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, its nodes and one byte of each minwise value."""

    def describe(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        shingles = Shingles(k)
        for batch in (b.iloc[i : i + 1000] for b in batches for i in range(0, len(b), 1000)):
            sets = [shingles(t) for t in batch["text"]]
            values = np.array([minwise(s) for s in sets], np.uint64).reshape(-1, COORDINATES)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "nodes": list(leaves(values, trees).astype(np.int64)),
                "sketch": [row.tobytes() for row in (values >> np.uint64(56)).astype(np.uint8) ^ (values >> np.uint64(20)).astype(np.uint8)],
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        describe, "doc_id long, n_shingles long, digest binary, nodes array<long>, sketch binary"
    )


def components(edges: DataFrame) -> DataFrame:
    """u, v of any links to: node and label, the smallest node that it is connected to. Alternates large and small stars.

    A node with very many links makes one side of a join uneven, never both, so that Spark can split its partition.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = support.materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        new = support.materialise(new.distinct(), "edges")
        support.discard(edges, large)
        edges = new
        # Stars are left when no node has two smaller neighbours, or one smaller and one larger.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _sketches(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, COORDINATES)


def _whole_groups(batches: Iterable[pd.DataFrame], *keys: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut so that rows of one group, which stand together, stay together; with their group numbers."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        group = _group_numbers(rows, keys)
        whole = np.flatnonzero(group == group[-1])[0]  # the last group may go on in the next batch
        held = rows.iloc[whole:]
        if whole:
            yield rows.iloc[:whole].reset_index(drop=True), group[:whole]
    if held is not None and len(held):
        yield held.reset_index(drop=True), _group_numbers(held, keys)


def _group_numbers(rows: pd.DataFrame, keys: tuple[str, ...]) -> np.ndarray:
    values = rows[list(keys)].to_numpy()
    return np.concatenate([[0], np.cumsum((values[1:] != values[:-1]).any(axis=1))])


def _candidates(rows: pd.DataFrame, group: np.ndarray, percent: int, agree: int) -> pd.DataFrame:
    """Candidate pairs u > v of different labels in each group, which is a small node or a block of a large one with its leader.

    All of a node's candidates if they are at most twice its classes; else one for each class, and a row with the node in more.
    In a large node only the leader, its smallest class, is compared with the others, and the node is in more anyway; alike
    counts those that agree with it.
    """
    sketch, node = _sketches(rows), rows["node"].to_numpy()
    rep, label, size, large = (rows[c].to_numpy() for c in ("rep", "label", "n_shingles", "large"))
    left, right, score = [], [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        fits = (label[i] != label[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[fits], j[fits]
        same = (sketch[i] == sketch[j]).sum(axis=1)
        enough = same >= agree
        left.append(i[enough])
        right.append(j[enough])
        score.append(same[enough])

    sizes = np.bincount(group)
    at = np.flatnonzero((sizes[group] <= 64) & ~large)
    apart = 1
    while len(at):  # small groups all at once: neighbours, then rows two apart, and so on
        at = at[at + apart < len(group)]
        at = at[group[at + apart] == group[at]]
        for k in range(0, len(at), 65_536):
            add(at[k : k + 65_536], at[k : k + 65_536] + apart)
        apart += 1
    for g in np.flatnonzero((sizes > 64) | (np.bincount(group, large) > 0)):
        members = np.flatnonzero(group == g)
        if large[members[0]]:
            first = members[np.argmin(rep[members])]
            add(np.full(len(members) - 1, first), members[members != first])
            continue
        for k, i in enumerate(members[:-1]):
            add(np.full(len(members) - 1 - k, i), members[k + 1 :])
    i, j, same = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, score))
    found = np.bincount(group[i], minlength=len(sizes))
    crowded = (found > 2 * sizes) | (np.bincount(group, large) > 0)
    # In crowded nodes each class takes the smallest one that it is surely like, or else the one that it is most like.
    some = crowded[group[i]]
    a, b, s = np.concatenate([i[some], j[some]]), np.concatenate([j[some], i[some]]), np.concatenate([same[some]] * 2)
    sure = s >= COORDINATES * percent / 100 + COORDINATES / 32
    order = np.lexsort((rep[b], np.where(sure, 0, -s), ~sure, a))
    first = np.ones(len(order), bool)
    first[1:] = a[order][1:] != a[order][:-1]
    a, b = a[order][first], b[order][first]
    i, j = np.concatenate([i[~some], a]), np.concatenate([j[~some], b])
    pairs = np.unique(np.stack([np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])], 1), axis=0)
    more = np.flatnonzero(crowded)
    none = np.full(len(more), -1)
    return pd.concat([
        pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1], "more": None, "alike": 0}),
        pd.DataFrame({"u": none, "v": none, "more": node[np.searchsorted(group, more + group[0])], "alike": found[more]}),
    ]).astype({"more": "Int64"})


def _links(rows: pd.DataFrame, percent: int, agree: int) -> list[tuple[int, int]]:
    """Links between classes of different labels in one tile, on full sets; what is connected on the way isn't compared again.

    Each row of the tile's sides 0 and 2 is held against each of its sides 1 and 2. The Jaccard distance is a metric, so classes whose distances to
    a pivot differ by more than a link allows needn't be compared. A pair that shares several nodes is compared in the smallest of them.
    """
    sketch = _sketches(rows)
    rep, label, size, minor, side = (rows[c].to_numpy() for c in ("rep", "label", "n_shingles", "minor", "side"))
    node = int(rows["node"].iloc[0])
    mine = [frozenset(x) for x in rows["mine"]]
    sets = [np.asarray(x) for x in rows["set"]]  # sorted
    own, others = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(own) or not len(others):
        return []

    def similarity(i: int, j: int) -> tuple[int, int]:
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return common, len(sets[i]) + len(sets[j]) - common

    agreement = (sketch[others][:, None, :] == sketch[others[np.linspace(0, len(others) - 1, min(len(others), 16)).astype(int)]][None]).mean(axis=(1, 2))
    pivot = int(others[np.argmax(agreement)])
    away = np.array([1 - (c / u if u else 0) for c, u in (similarity(i, pivot) for i in range(len(rows)))])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for i in own:
        js = others if not minor[i] else others[rep[others] > rep[i]]
        js = js[(label[js] != label[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
        js = js[np.abs(away[js] - away[i]) <= 1 - percent / 100 + 1e-9]
        same = (sketch[js] == sketch[i]).sum(axis=1)
        js, same = js[same >= agree], same[same >= agree]
        for j in js[np.argsort(-same, kind="stable")]:
            a, b = root(label[i]), root(label[j])
            if a == b or min(mine[i] & mine[j]) != node:
                continue
            common, union = similarity(i, j)
            if 100 * common >= percent * union:
                parent[max(a, b)] = min(a, b)
                out.append((max(rep[i], rep[j]), min(rep[i], rep[j])))
    return out


class _Join:
    """One run over the classes of equal sets: who shares a node, and what is connected."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent = docs, classes, k, percent
        self.spark = docs.sparkSession
        t = percent / 100
        self.agree = max(0, math.floor(COORDINATES * (t - DEVIATIONS * math.sqrt(t * (1 - t) / COORDINATES))))
        self.labels = self.spark.createDataFrame([], "node long, label long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """rep and set (sorted) of the wanted classes, from their documents' texts."""
        k = self.k
        wanted = support.materialise(wanted.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)

        def shingled(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingles = Shingles(k)
            for batch in batches:
                for i in range(0, len(batch), 200):
                    some = batch.iloc[i : i + 200]
                    sets = [shingles(t) for t in some["text"]]
                    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                    yield pd.DataFrame({"rep": some["doc_id"], "digest": digests, "set": [np.sort(s.astype(np.int64)) for s in sets]})

        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
        found = texts.mapInPandas(shingled, "rep long, digest binary, set array<long>")
        # A class is known by the smallest doc_id with its set; rows that share a doc_id can have several texts.
        return support.materialise(found.dropDuplicates(["rep", "digest"]).drop("digest"), "sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs u > v whose full sets are similar enough."""
        # The larger id's set comes by a plain join, as each id is u of few pairs; leaders are v of very many.
        count, total = pairs.groupBy("v").agg(F.count("*").alias("_n")), pairs.count()
        of_v = sets.select(F.col("rep").alias("v"), F.col("set").alias("set_v")).join(count, "v")
        with_u = pairs.join(sets.select(F.col("rep").alias("u"), F.col("set").alias("set_u")), "u")
        both = support.join_counted(with_u, of_v, "v", "_n", total, share=50)
        common = F.size(F.array_intersect("set_u", "set_v"))
        union = F.size("set_u") + F.size("set_v") - common
        return both.where(100 * common >= self.percent * union).select("u", "v").distinct()

    def shared(self, nodes: DataFrame) -> DataFrame:
        """Of node and rep, the rows of nodes that hold several classes."""
        several = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        return support.materialise(nodes.join(several, "node").select("node", "rep"), "shared")

    def apart(self, shared: DataFrame) -> DataFrame:
        """Rows of shared nodes with more than one label, with n_shingles, sketch, label, and the node's n and minors.

        minor says that a class hasn't the label that most of its node's classes have; minors counts these.
        """
        labels = self.labels.select(F.col("node").alias("rep"), "label")
        labelled = support.materialise(shared.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
        by = labelled.groupBy("node", "label").agg(F.count("*").alias("c"))
        several = (
            by.groupBy("node").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"), F.sum("c").alias("n"), F.max("c").alias("c"))
            .where("labels > 1").select("node", "most", "n", (F.col("n") - F.col("c")).alias("minors"))
        )
        rows = labelled.join(several, "node").select(*shared.columns, "label", "n", "minors", (F.col("label") != F.col("most")).alias("minor"))
        out = support.materialise(rows.join(self.classes.select("rep", "n_shingles", "sketch"), "rep"), "apart")
        support.discard(labelled)
        return out

    def branched(self, large: DataFrame) -> DataFrame:
        """The classes of large nodes in these nodes' children."""

        @F.pandas_udf("array<long>")
        def children(node: pd.Series, sketch: pd.Series) -> pd.Series:
            values = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, COORDINATES).astype(np.uint64)
            return pd.Series(list(_children(node.to_numpy().astype(np.uint64)[:, None], values).astype(np.int64)))

        return large.select("rep", F.explode(children("node", "sketch")).alias("node"))

    def compared(self, apart: DataFrame) -> DataFrame:
        """Candidate pairs u > v of nodes, and in more the nodes that have further ones, with alike; see _candidates()."""
        percent, agree = self.percent, self.agree
        large = F.col("n") > LARGE
        blocks = F.when(large, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int")
        leaders = apart.where(large).groupBy("node").agg(F.min("rep").alias("leader"))
        is_leader = F.col("leader").isNotNull() & (F.col("leader") == F.col("rep"))
        where = F.when(is_leader, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(_block("rep", blocks)))
        rows = apart.join(leaders, "node", "left").select("node", "rep", "label", "n_shingles", "sketch", large.alias("large"), F.explode(where).alias("block"))

        def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some, group in _whole_groups(batches, "node", "block"):
                yield _candidates(some, group, percent, agree)

        dealt = rows.repartition("node", "block").sortWithinPartitions("node", "block", "rep")
        return support.materialise(dealt.mapInPandas(compare, "u long, v long, more long, alike long"), "compared")

    def exact(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """The links in nodes of rows, compared on full sets in tiles, so that no pair without a link leaves its task.

        A node's classes are dealt out in blocks, its minor ones in parts as well, and a tile is a block with a part.
        """
        percent, agree = self.percent, self.agree
        mine = rows.groupBy("rep").agg(F.collect_set("node").alias("mine"))  # at most as many as a class has nodes
        blocks, parts = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("minors") / BLOCK).cast("int")
        # side: 0 for a row that is held against others, 1 for one that others are held against, 2 for both; no row goes to a tile twice.
        block, part = _block("rep", blocks), _block("label", parts)
        here = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(block.alias("block"), p.alias("part"), F.when(F.col("minor") & (p == part), 2).otherwise(0).alias("side")))
        there = F.transform(F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: b != block), lambda b: F.struct(b.alias("block"), part.alias("part"), F.lit(1).alias("side")))
        dealt = rows.withColumn("tile", F.explode(F.when(F.col("minor"), F.concat(here, there)).otherwise(here)))
        dealt = dealt.select("node", "rep", "label", "n_shingles", "sketch", "minor", "tile.*").join(mine, "rep").join(sets, "rep")

        def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some, group in _whole_groups(batches, "node", "block", "part"):
                for g in range(group[0], group[-1] + 1):
                    yield pd.DataFrame(_links(some[group == g].reset_index(drop=True), percent, agree), columns=["u", "v"])

        dealt = dealt.repartition("node", "block", "part").sortWithinPartitions("node", "block", "part", "side", "rep")
        return dealt.mapInPandas(compare, "u long, v long")

    def linked(self, found: DataFrame) -> None:
        """Takes links into the labels: components of the labels that they connect, so that old links aren't gone through again."""
        found = support.materialise(found, "links")
        if found.isEmpty():
            return
        before = self.labels
        of = lambda side: before.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        between = found.join(of("u"), "u", "left").join(of("v"), "v", "left")
        between = between.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
        new = support.materialise(components(between), "new-labels")
        moved = before.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
        moved = moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(new)
        # A label that moves is a node of both; the moved row and the new one agree, as before holds a row for each label.
        self.labels = support.materialise(moved.groupBy("node").agg(F.min("label").alias("label")), "labels")
        support.discard(found, new, before)

    def run(self) -> DataFrame:
        """node and label of all classes that are linked."""
        level = self.shared(self.classes.select("rep", F.explode("nodes").alias("node")))
        for deeper in range(MORE_LEVELS + 1):
            apart = self.apart(level)
            found = self.compared(apart)
            pairs = support.materialise(found.where("more IS NULL").select("u", "v").distinct(), "pairs")
            sets = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("rep")))
            self.linked(self.verified(pairs, sets))
            crowded = found.where("more IS NOT NULL").groupBy(F.col("more").alias("node")).agg(F.sum("alike").alias("alike"))
            left = support.materialise(level.join(crowded, "node"), "crowded")
            support.discard(apart, pairs, level, found)
            open_ = self.apart(left)
            support.discard(left)
            # Branching parts what is unlike. A large node of classes that are much alike stays together, so it is compared as it is.
            apart_enough = (F.col("n") > LARGE) & (F.col("alike") < DENSE * F.col("n"))
            if deeper == MORE_LEVELS:
                apart_enough = F.lit(False)
            here = open_.where(~apart_enough)
            if not here.isEmpty():
                more = here.where(F.col("n") > LARGE).join(sets.select("rep"), "rep", "left_anti")  # of small nodes, all that have a candidate are there
                all_sets = sets if more.isEmpty() else sets.unionByName(self.sets(more))
                self.linked(self.exact(here, all_sets))
            support.discard(sets)
            further = open_.where(apart_enough)
            if further.isEmpty():
                break
            level = self.shared(self.branched(further))
            support.discard(open_)
        return self.labels


def _block(key: str, of: Column) -> Column:
    return F.pmod(F.xxhash64(key), of).cast("int")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; documents are linked if 100 |A and B| >= percent |A or B|.

    docs: doc_id and text, a table, as it is read more than once; more columns are ignored. component_id
    is the smallest doc_id that links lead to, the document's own included, and kept says that it is its own.

    Texts without words, and null texts, have no shingles and no links. Rows that share a doc_id are one
    document, linked wherever one of its texts is. A row without doc_id counts as unlinked, with a null component_id, and is kept.
    """
    rows = support.materialise(described(docs, k, trees_for(percent / 100)), "described")
    total = rows.count()
    some = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = support.materialise(
        some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("nodes").alias("nodes"), F.any_value("sketch").alias("sketch")),
        "classes",
    )
    members = support.materialise(rows.select("doc_id", "n_shingles", "digest"), "members")
    support.discard(rows)
    labels = _Join(docs, classes, k, percent).run()
    named = classes.select("digest", "rep", "n").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    named = support.materialise(named.select("digest", "n", F.coalesce("label", "rep").alias("component_id")), "named")
    support.discard(classes, labels)
    linked = support.join_counted(members.where("digest IS NOT NULL AND doc_id IS NOT NULL"), named, "digest", "n", total).select("doc_id", "n_shingles", "component_id")
    alone = members.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
