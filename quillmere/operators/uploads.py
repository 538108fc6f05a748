"""Uploads in one go: files of a folder are checked, kept under the digest of their bytes, decoded, and fail where there is no text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import strings
from quillmere.operators import connectors, text

UNREADABLE, NO_TEXT = "could not read text from this file", "no readable text found in this file"


def landed(spark: SparkSession, path: str, user: str) -> DataFrame:
    """user_id, name and content of every file under a folder that isn't empty (Spark lists no others); file names are decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1)
    return files.select(F.lit(user).alias("user_id"), name.alias("name"), "content")


def uploaded(files: DataFrame) -> DataFrame:
    """user_id, name, kind, size, storage_key, status, error, text and chars of files (user_id, name, content, maybe mime).

    A file of no known kind, an empty one or one that is too large is REFUSED and gets no key. Others are kept under user, digest of the bytes and safe name, so that the same file
    of a user is one object. Text files are decoded and normalised as documents are, and are QUEUED; other kinds need a reader that isn't here and FAIL, as do files without text.
    """
    mime = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    refused = connectors.upload_error(F.col("name"), mime, size)
    rows = files.select("user_id", "name", connectors.upload_kind(F.col("name"), mime).alias("kind"), size.alias("size"), refused.alias("refused"), F.when(refused.isNull(), F.col("content")).alias("content"))
    key = F.when(F.col("refused").isNull(), F.concat_ws("/", "user_id", F.sha2("content", 256), strings.safe_key(F.col("name"))))
    decoded = text.surface_clean(text.nfc(text.decoded(F.col("content"), F.lit(True))))
    rows = rows.withColumn("storage_key", key).withColumn("text", F.when(F.col("refused").isNull() & (F.col("kind") == "text"), decoded))
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    error = F.coalesce("refused", F.when(F.col("kind") != "text", UNREADABLE).when(blank, NO_TEXT))
    status = F.when(F.col("refused").isNotNull(), "REFUSED").when(error.isNotNull(), "FAILED").otherwise("QUEUED")
    shown = F.when(status == "QUEUED", F.col("text"))
    return rows.select("user_id", "name", "kind", "size", "storage_key", status.alias("status"), error.alias("error"), shown.alias("text"), F.coalesce(F.length(shown), F.lit(0)).alias("chars"))


def payloads(rows: DataFrame) -> DataFrame:
    """What goes to the queue of uploaded() rows: one message for each object, the smallest by name."""
    once = rows.where("status = 'QUEUED'").groupBy("user_id", "storage_key").agg(F.min(F.struct("name", "text")).alias("f"))
    return once.select(
        F.col("storage_key").alias("raw_document_id"), F.lit("upload").alias("source"), F.col("storage_key").alias("external_id"), F.lit("").alias("author"), F.col("f.name").alias("subject"),
        F.col("f.text").alias("content"), F.concat_ws(":", "user_id", F.lit("upload")).alias("namespace"),
    )
