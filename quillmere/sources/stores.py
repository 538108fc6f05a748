"""Stores: per-tenant feature tables, append-only forecasts, content-addressed objects, CSV exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENANT = re.compile(r"[A-Za-z0-9_.:-]{1,128}")


class ForeignTenant(ValueError):
    """Rows of another tenant were about to be written or were read."""


def tenant(name: str) -> str:
    if not TENANT.fullmatch(name):
        raise ValueError(f"not a tenant: {name!r}")
    return name


def scoped(frame: DataFrame, name: str) -> DataFrame:
    """A tenant's rows; every read for a tenant goes through here."""
    return frame.where(F.col("tenant_id") == tenant(name))


def _own(frame: DataFrame, name: str) -> DataFrame:
    if not frame.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant(name)))).isEmpty():
        raise ForeignTenant(name)
    return frame


def write_features(frame: DataFrame, root: str, name: str) -> None:
    """Replaces a tenant's features; raises before writing if a row is another tenant's."""
    _own(frame, name).write.mode("overwrite").parquet(f"{root}/tenant={tenant(name)}")


def read_features(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _own(spark.read.parquet(f"{root}/tenant={tenant(name)}"), name)


def append_forecasts(frame: DataFrame, root: str) -> None:
    """Adds forecasts and keeps the older ones, so that elapsed weeks can be held against them."""
    frame.write.mode("append").partitionBy("tenant_id", "target").parquet(root)


def latest_forecasts(spark: SparkSession, root: str) -> DataFrame:
    own = spark.read.parquet(root)
    newest = own.groupBy("tenant_id", "target").agg(F.max("made_at").alias("made_at"))
    return own.join(newest, ["tenant_id", "target", "made_at"], "left_semi")


def object_keys(objects: DataFrame) -> DataFrame:
    """Adds key, tenant/sha256 of content, so that equal bytes of a tenant are one object."""
    return objects.withColumn("key", F.concat_ws("/", "tenant_id", F.sha2("content", 256)))


def new_objects(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each object that the store doesn't hold."""
    return object_keys(objects).dropDuplicates(["key"]).join(stored.select("key"), "key", "left_anti")


def export_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)
