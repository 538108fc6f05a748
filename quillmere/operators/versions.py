"""Versions over time: statistics and models that are valid from an instant on, the version that was valid at another, and whether a new model may take over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str) -> DataFrame:
    """Every left row with the columns of the last right row of its keys that is not later than it; nulls where there is none.

    Both sides go through one window for each key, in which the last right row is carried on: no row meets more than one other, however many versions
    there are. Of right rows of one key and time the greatest by their other columns counts. A null time or key of the left matches nothing; of the right, is never valid.
    Names of right columns that aren't keys must not be those of left ones.
    """
    values = [c for c in right.columns if c not in keys]
    if set(values) & set(left.columns):
        raise ValueError(f"names on both sides: {sorted(set(values) & set(left.columns))}")
    whole = F.col(left_at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    valid = right.where(F.col(right_at).isNotNull()).groupBy(*keys, right_at).agg(F.max(F.struct(*[c for c in values if c != right_at] or [F.lit(0).alias("_none")])).alias("_v"))
    marked = valid.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(right_at), *[F.col(f"_v.{c}") for c in values if c != right_at]).alias("_right"))
    rows = left.where(whole).select(*keys, F.col(left_at).cast(right.schema[right_at].dataType).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = marked.unionByName(rows, allowMissingColumns=True)
    carried = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_right", carried).where("_side = 1").select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in values])
    lost = left.where(~F.coalesce(whole, F.lit(False))).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values])
    return found.unionByName(lost)


def fingerprint(columns: list[str]) -> Column:
    """Sixteen hexadecimal digits that tell values apart, whatever the order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256), 1, 16)


def changed(observed: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """A slowly changing table of observed values: keys, valid_from, valid_to (null: still), version (from 1), fingerprint and values; observations that say the same as the one before make no version."""
    order = Window.partitionBy(*keys).orderBy(at, "fingerprint")
    own = observed.withColumn("fingerprint", fingerprint(values))
    kept = own.withColumn("_before", F.lag("fingerprint").over(order)).where("NOT fingerprint <=> _before").drop("_before")
    return kept.select(*keys, F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"), F.row_number().over(order).alias("version"), "fingerprint", *values)


def gate(losses: DataFrame, least_gain: float = 0.0, worst_loss: float = 0.05, least_pairs: int = 8) -> DataFrame:
    """model, promote, reason and figures for challengers whose losses are held against the champion's on the same cases.

    losses: model, tenant_id, week, champion and challenger (their losses of one case; null: not measured, which is no pair). A challenger takes over if the mean
    of its gain is above least_gain by two standard errors, there are least_pairs pairs, and no tenant's mean loss grew by over worst_loss of the champion's.
    """
    gain = F.col("champion") - F.col("challenger")
    pairs = losses.where(gain.isNotNull() & ~F.isnan(gain.cast("double")))
    tenants = pairs.groupBy("model", "tenant_id").agg(F.avg("champion").alias("old"), F.avg("challenger").alias("new"))
    worse = F.when(F.col("old") > 0, F.col("new") / F.col("old") - 1).when(F.col("new") > 0, float("inf")).otherwise(0.0)
    worst = tenants.groupBy("model").agg(F.max(worse).alias("worst_change"), F.max_by("tenant_id", F.struct(worse, "tenant_id")).alias("worst_tenant"))
    whole = pairs.groupBy("model").agg(F.count("*").alias("pairs"), F.avg(gain).alias("gain"), (F.coalesce(F.stddev_samp(gain), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("error"))
    every = losses.select("model").distinct().join(whole, "model", "left").join(worst, "model", "left")
    reason = (
        F.when(F.coalesce("pairs", F.lit(0)) < least_pairs, "too few pairs").when(F.col("gain") - 2 * F.col("error") <= least_gain, "no sure gain")
        .when(F.col("worst_change") > worst_loss, "worse for a tenant").otherwise("better")
    )
    return every.select("model", (reason == "better").alias("promote"), reason.alias("reason"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "gain", "error", "worst_change", "worst_tenant")
