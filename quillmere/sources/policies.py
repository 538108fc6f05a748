"""Row policies: views that show the rows of the session's tenant alone, and writes that only take them. Without a tenant nothing is seen or written."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.sources.stores import tenant as checked

VARIABLE = "session_tenant"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def enter(spark: SparkSession, tenant: str | None) -> None:
    """Makes tenant the session's; None leaves it without one."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    if tenant is not None:
        spark.sql(f"SET VARIABLE {VARIABLE} = '{checked(tenant)}'")


def guard(spark: SparkSession, frame: DataFrame, name: str, column: str = "tenant_id") -> None:
    """Makes a view of that name with the rows of whoever is the session's tenant when it is queried; the filter reaches the scan."""
    if not (_NAME.fullmatch(name) and _NAME.fullmatch(column)):
        raise ValueError(f"not a name: {name!r}, {column!r}")
    enter(spark, None)
    frame.createOrReplaceTempView(f"unguarded_{name}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM unguarded_{name} WHERE CAST({column} AS STRING) = {VARIABLE}")


def own_rows(spark: SparkSession, frame: DataFrame, column: str = "tenant_id") -> DataFrame:
    """frame, whose rows fail the job that reads them if they aren't the session's tenant's: for everything that is written."""
    now = spark.sql(f"SELECT {VARIABLE} AS t").first().t
    if now is None:
        raise PermissionError("the session has no tenant")
    own = F.col(column).cast("string").eqNullSafe(F.lit(now))
    return frame.withColumn(column, F.when(own, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("a row of another tenant: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast(frame.schema[column].dataType)))
