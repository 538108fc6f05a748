"""Graphs of knowledge scopes: transitive closure, refusal of cycles, layers, connected classes, and chains of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.sources import staging


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, upstream: all that a node depends on over source -> target edges, itself excluded; cycles are safe.

    Ways double in length with each round, so that the number of rounds is the logarithm of the longest; it ends when nothing is new. A round joins
    the ends of ways of just 2^i edges to all pairs that are so far apart at most, so that in a forest each pair is found once, and only new pairs are written.
    """
    exact = staging.written(edges.select(F.col("target").alias("node"), F.col("source").alias("upstream")).distinct(), "ways")
    found = exact
    for _ in range(rounds):
        ahead = exact.select("node", F.col("upstream").alias("_via"))
        behind = lambda pairs: pairs.select(F.col("node").alias("_via"), "upstream").hint("merge")
        step = ahead.join(behind(found), "_via").select("node", "upstream").distinct()
        new = staging.written(step.join(found.hint("merge"), ["node", "upstream"], "left_anti"), "closure")
        if new.isEmpty():
            break
        longer = staging.written(ahead.join(behind(exact), "_via").select("node", "upstream").distinct(), "ways")
        if exact is not found:
            staging.discard(exact)
        exact, found = longer, found.unionByName(new)
    return found.where("node <> upstream")


def link_refusals(proposed: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds reason to proposed source -> target links: self, duplicate, cycle, or null where the link may be made."""
    up = closure(edges).select(F.col("node").alias("source"), F.col("upstream").alias("target"), F.lit(True).alias("_cycle"))
    there = edges.select("source", "target", F.lit(True).alias("_there")).distinct()
    joined = proposed.join(there, ["source", "target"], "left").join(up, ["source", "target"], "left")
    reason = F.when(F.col("source") == F.col("target"), "self").when(F.col("_there"), "duplicate").when(F.col("_cycle"), "cycle")
    return joined.select("source", "target", reason.alias("reason"))


def layers(edges: DataFrame) -> DataFrame:
    """node, layer of an acyclic graph: the longest way to a node from one without inputs. Raises ValueError if there is a cycle.

    Nodes without inputs are taken off, layer by layer, so that every edge is gone through once however many paths there are. No layer goes through the driver.
    """
    left = staging.written(edges.select("source", "target").distinct(), "edges")
    nodes = staging.written(left.select(F.col("source").alias("node")).union(left.select("target")).distinct(), "nodes")
    done, layer = None, 0
    while not nodes.isEmpty():
        free = staging.written(nodes.join(left.select(F.col("target").alias("node")).hint("merge"), "node", "left_anti"), "free")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        rest = staging.written(nodes.join(free.hint("merge"), "node", "left_anti"), "nodes")
        kept = staging.written(left.join(free.select(F.col("node").alias("source")).hint("merge"), "source", "left_anti"), "edges")
        staging.discard(nodes, left)
        nodes, left = rest, kept
        own = free.withColumn("layer", F.lit(layer))
        done, layer = own if done is None else done.unionByName(own), layer + 1
    return done if done is not None else nodes.withColumn("layer", F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """node, label of all nodes with links (u, v of any order): the smallest node that links lead to. Alternates large and small stars.

    A node with very many links makes one side of a join uneven, never both, so that Spark can split its partition.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = staging.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        new = staging.written(new.distinct(), "links")
        staging.discard(edges, large)
        edges = new
        # Stars are left when no node has two smaller neighbours, or one smaller and one larger.
        end = lambda side, below, above: edges.select(F.col(side).alias("node"), F.lit(below).alias("below"), F.lit(above).alias("above"))  # noqa: B023, E731
        ends = end("u", 1, 0).unionByName(end("v", 0, 1)).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if ends.where("below > 1 OR below = 1 AND above = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select("v", "v").distinct().toDF("node", "label"))


def heads(versions: DataFrame, rounds: int = 64) -> DataFrame:
    """id, head, steps: the newest version that replaces each one, over id -> superseded_by. Pointers double with each round.

    A superseding id that isn't there itself is the head of its chain.
    """
    now = versions.select("id", F.coalesce("superseded_by", "id").alias("head"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).alias("steps"))
    for _ in range(rounds):
        nxt = now.select(F.col("id").alias("head"), F.col("head").alias("_next"), F.col("steps").alias("_more"))
        more = F.coalesce("_more", F.lit(0))
        moved = now.join(nxt, "head", "left").select("id", F.coalesce("_next", "head").alias("head"), (F.col("steps") + more).alias("steps"), (more > 0).alias("_moved"))
        moved = staging.written(moved, "heads")
        staging.discard(now)
        now = moved
        if moved.where("_moved").isEmpty():
            break
    return now.drop("_moved") if "_moved" in now.columns else now
