"""How filters of documents act on each other, whatever their order.

A document is, to the audit, the set of filters that it fails. Applying filters one after another in any order
walks a lattice of subsets, from the empty one to all, so that what a step removes depends only on the edge it takes: (subset
applied before, next filter). Documents are counted on the edges, of which n filters have n * 2^(n-1), and orders
are made of the edges' counts by a join; the n! orders never meet a document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm import support

#: White space that parts words, and what filter D looks for.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
FILTERS = "ABCDE"

COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides; text isn't null.

    A: under 100 words. B: under 80 % of the words are distinct. C: over 10 % of the characters are A-Z. D: any of ``#$%&*|``.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, part and failed of every row of docs: failed has bit k where the document fails FILTERS[k].

    E fails where a row of docs with the same text has a smaller doc_id. Texts are told apart by SHA-256; of each digest only the
    smallest doc_id and the number of rows are shuffled and joined back, and digests with many rows are broadcast. A null text is empty, a null lang the part ''.
    A row without doc_id is no one's predecessor and has none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(bad, 1 << FILTERS.index(name)).otherwise(0) for name, bad in text_failures(F.col("text")).items()), F.lit(0))
    rows = support.materialise(rows.select("doc_id", "part", bits.alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")), "failed", "snappy")
    same = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    joined = support.join_counted(rows, support.materialise(same, "copies"), "digest", "n", rows.count(), "left")
    copied = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("failed") + F.when(copied, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))


def lattice(n: int) -> list[tuple[int, int]]:
    """All edges (subset applied before, next filter) of n filters."""
    return [(before, k) for before in range(1 << n) for k in range(n) if not before >> k & 1]


def audit(failed: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part's counts at each step of each order of the filters.

    failed: doc_id, part, failed (bits by place in filters). labels: doc_id, quality, toxic; of a document's several labels the largest count,
    and one that isn't labelled is neither good nor toxic. Returns part, filter_order, step (from 1) and long counts: kept after the step, removed by it,
    redundant (fails its filter, but removed before), unique_fails (fails that filter alone), good_lost and toxic_lost (removed with quality = 1 or
    toxic = 1), and shapley, the sum of removed by the step's filter over all orders. Without documents there are no parts and no rows. Documents meet
    labels by doc_id, whose copies are few; all later tables are as small as the lattice times the parts.
    """
    n, spark = len(filters), failed.sparkSession
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = failed.join(one, "doc_id", "left").select(
        "part", "failed", F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long").alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long").alias("toxic")
    )
    sets = known.groupBy("part", "failed").agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # Each set of documents goes to all edges.
    edge = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(k).alias("next")) for before, k in lattice(n)]))
    at = sets.select("*", edge.alias("edge")).select("*", "edge.before", "edge.next")
    bit = F.expr("shiftleft(1, next)")
    fails, gone = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, of: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    edges = at.groupBy("part", "before", "next").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("failed") == bit).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    steps, name = [], {letter: k for k, letter in enumerate(filters)}
    for order in map("".join, permutations(filters)):
        for place, letter in enumerate(order):
            steps.append((order, place + 1, sum(1 << name[x] for x in order[:place]), name[letter]))
    schema = T.StructType([T.StructField("filter_order", T.StringType()), *(T.StructField(x, T.IntegerType()) for x in ("step", "before", "next"))])
    # n! * n rows for n filters, whatever the data.
    paths = F.broadcast(spark.createDataFrame(steps, schema))
    walked = edges.join(paths, ["before", "next"])
    shares = walked.groupBy("part", "next").agg(F.sum("removed").alias("shapley"))
    return walked.join(shares, ["part", "next"]).select("part", "filter_order", "step", *COUNTS[:3], "unique_fails", *COUNTS[3:], "shapley")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters over all documents, by lang. docs: doc_id, text, lang; further columns are left out."""
    return audit(failed_sets(docs), labels)
