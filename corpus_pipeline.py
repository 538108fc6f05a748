"""Corpus pipeline: toxicity, exact duplicates, near duplicates, then packing into training sequences.

Each stage takes what its predecessor kept, as a table, and all but the last return the columns of
documents; the last returns where each document's pieces lie in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import exact_dedup, near_dedup, packing, support, toxicity


def _columns(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents alone; without columns of other names that docs may have."""
    return docs.select(*support.read(spark, sf_dir, "documents").columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of the documents at hand that aren't held out."""
    docs = _columns(spark, docs, sf_dir)
    model = toxicity.train(docs, support.read(spark, sf_dir, "labels"))
    names = tuple(docs.columns)
    return toxicity.score(docs, model, keep=names).where("predicted = 0").select(*names)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id. The lower half of the doc_ids stands for the snapshot."""
    docs = _columns(spark, docs, sf_dir)
    found = exact_dedup.deduplicate(docs, exact_dedup.lower_half(docs))
    digest = F.sha2(support.ascii_lower(F.coalesce("text", F.lit(""))), 256)  # as deduplicate() has it
    dropped = support.materialise(found.where("NOT kept").select("doc_id", "text_sha256").distinct(), "dropped")
    return docs.withColumn("text_sha256", digest).join(dropped, ["doc_id", "text_sha256"], "left_anti").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id.

    Rows that share a doc_id are documents of their own, each judged by its text; so is a row without one.
    """
    docs = _columns(spark, docs, sf_dir)
    rows, ids, known = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.count("doc_id")).first()
    if rows == ids == known:
        numbered = docs.withColumn("number", F.col("doc_id").cast("long"))
    else:  # numbers in the order of doc_ids, fixed by writing them
        numbered = support.materialise(docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").withColumn("number", F.monotonically_increasing_id()), "numbered", "snappy")
    found = near_dedup.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), k=5, percent=80)
    dropped = support.materialise(found.where("NOT kept").select(F.col("doc_id").alias("number")), "dropped")
    return numbered.join(dropped, "number", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document lie in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written as Parquet and read again."""
    docs = support.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = support.materialise(docs, f"stage-{name}", "snappy")
    return docs
