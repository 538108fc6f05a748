"""Keys of tenants: random data keys wrapped by a master key, wrapped anew when that changes, and shredded with all that they sealed."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.operators.ingestion import opened, sealed
from quillmere.sources import staging

BYTES = 32


@F.pandas_udf(T.BinaryType())
def _random(rows: pd.Series) -> pd.Series:
    return rows.map(lambda _: os.urandom(BYTES))


def issued(tenants: DataFrame, master: bytes, known: DataFrame | None = None) -> DataFrame:
    """tenant_id, wrapped and master_version for tenants (tenant_id) that have no key yet and those of known, as a written table: a key is drawn once."""
    new = tenants.select("tenant_id").where("tenant_id IS NOT NULL").distinct()
    if known is not None:
        new = new.join(known.select("tenant_id"), "tenant_id", "left_anti")
    drawn = new.withColumn("key", _random.asNondeterministic()("tenant_id"))
    keys = drawn.select("tenant_id", F.aes_encrypt("key", F.lit(master), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.col("tenant_id").cast("string").cast("binary")).alias("wrapped"), F.lit(0).alias("master_version"))
    return staging.written(keys if known is None else keys.unionByName(known), "tenant-keys")


def rotated(keys: DataFrame, old: bytes, new: bytes) -> DataFrame:
    """The same keys wrapped by a new master key; what they sealed stays as it is. A key that the old one doesn't open fails the job."""
    tenant = F.col("tenant_id").cast("string").cast("binary")
    plain = F.coalesce(F.try_aes_decrypt("wrapped", F.lit(old), F.lit("GCM"), F.lit("DEFAULT"), tenant), F.raise_error(F.lit("the master key doesn't open a tenant's key")).cast("binary"))
    wrapped = F.aes_encrypt(plain, F.lit(new), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), tenant)
    return staging.written(keys.select("tenant_id", wrapped.alias("wrapped"), (F.col("master_version") + 1).alias("master_version")), "tenant-keys")


def shredded(keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """keys without those of tenants (tenant_id): nothing that they sealed can be opened again."""
    return staging.written(keys.join(tenants.select("tenant_id"), "tenant_id", "left_anti"), "tenant-keys")


def _with_keys(rows: DataFrame, keys: DataFrame, master: bytes) -> DataFrame:
    tenant = F.col("tenant_id").cast("string").cast("binary")
    return rows.join(keys.select("tenant_id", F.try_aes_decrypt("wrapped", F.lit(master), F.lit("GCM"), F.lit("DEFAULT"), tenant).alias("_key")), "tenant_id", "left")


def seal(rows: DataFrame, column: str, keys: DataFrame, master: bytes) -> DataFrame:
    """rows with a column sealed under their tenants' keys; a tenant without a key fails the job."""
    key = F.coalesce("_key", F.raise_error(F.lit("a tenant has no key")).cast("binary"))
    return _with_keys(rows, keys, master).withColumn(column, sealed(F.col(column), key, F.col("tenant_id").cast("string"))).drop("_key")


def unseal(rows: DataFrame, column: str, keys: DataFrame, master: bytes) -> DataFrame:
    """rows with a column opened; null where the tenant's key is gone or the value isn't its own."""
    return _with_keys(rows, keys, master).withColumn(column, opened(F.col(column), F.col("_key"), F.col("tenant_id").cast("string"))).drop("_key")
