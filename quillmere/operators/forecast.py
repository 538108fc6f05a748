"""Forecast support: normalisers, windows, splits, calibration, drift, baseline quantiles and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def in_order() -> WindowSpec:
    return Window.partitionBy("tenant_id").orderBy("bucket")


def newest_first() -> WindowSpec:
    return Window.partitionBy("tenant_id").orderBy(F.desc("bucket"))


def fit_normaliser(frame: DataFrame, columns: dict[str, bool], train_end: Column) -> DataFrame:
    """tenant_id, feature, mean, std (of the sample) of buckets up to train_end. columns: name, and whether it is a count, which is log-scaled."""
    used = frame.where(F.col("bucket") <= train_end)
    values = [F.struct(F.lit(c).alias("feature"), (F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if count else F.col(c).cast("double")).alias("x")) for c, count in columns.items()]
    long = used.select("tenant_id", F.explode(F.array(*values)).alias("v")).select("tenant_id", "v.feature", "v.x")
    return long.groupBy("tenant_id", "feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def normalise(frame: DataFrame, stats: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """tenant_id, bucket, feature, z and the cyclic calendar; missing values become 0."""
    values = [F.struct(F.lit(c).alias("feature"), (F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) if count else F.col(c).cast("double")).alias("x")) for c, count in columns.items()]
    long = frame.select("tenant_id", "bucket", F.explode(F.array(*values)).alias("v")).select("tenant_id", "bucket", "v.feature", "v.x")
    angle = 2 * F.pi() * F.weekofyear("bucket") / 52
    z = F.coalesce((F.col("x") - F.col("mean")) / (F.col("std") + 1e-6), F.lit(0.0))
    return long.join(stats, ["tenant_id", "feature"]).select("tenant_id", "bucket", "feature", z.alias("z"), F.sin(angle).alias("week_sin"), F.cos(angle).alias("week_cos"))


def windows(frame: DataFrame, column: str, encoder: int, horizon: int) -> DataFrame:
    """Every full pair of ``encoder`` past values and ``horizon`` values to come."""
    past = F.collect_list(column).over(in_order().rowsBetween(-(encoder - 1), 0))
    coming = F.collect_list(column).over(in_order().rowsBetween(1, horizon))
    return frame.withColumn("past", past).withColumn("coming", coming).where((F.size("past") == encoder) & (F.size("coming") == horizon))


def split(frame: DataFrame, horizon: int, lookback: int) -> DataFrame:
    """Adds in_train and in_validation: the last ``horizon`` buckets are held out, and validation looks back over some before them."""
    place = F.row_number().over(newest_first())
    return frame.withColumn("_p", place).withColumn("in_train", F.col("_p") > horizon).withColumn("in_validation", F.col("_p") <= horizon + lookback).drop("_p")


def padded(frame: DataFrame, column: str, n: int) -> DataFrame:
    """tenant_id and the last n values, padded with zeros on the left."""
    last = frame.withColumn("_p", F.row_number().over(newest_first())).where(F.col("_p") <= n)
    values = F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce(F.col(column), F.lit(0.0)).alias("x")))), lambda s: s["x"])
    return last.groupBy("tenant_id").agg(values.alias("v")).select("tenant_id", F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size("v")), "v").alias("window"))


def naive_quantiles(frame: DataFrame, column: str, season: int, horizon: int) -> DataFrame:
    """tenant_id, step, p10, p50, p90: the value a season ago with the quantiles of past errors of doing so, in order."""
    lagged = frame.withColumn("e", F.col(column) - F.lag(column, season).over(in_order()))
    errors = lagged.where("e IS NOT NULL").groupBy("tenant_id").agg(F.percentile("e", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    last = frame.withColumn("p", F.row_number().over(newest_first())).where(F.col("p") <= season)
    steps = last.select("tenant_id", F.explode(F.sequence(F.lit(0), F.lit((horizon - 1) // season))).alias("k"), (season - F.col("p") + 1).alias("i"), F.col(column).alias("x"))
    base = steps.select("tenant_id", (F.col("k") * season + F.col("i")).alias("step"), "x").where(F.col("step") <= horizon)
    sorted_ = F.array_sort(F.transform("q", lambda e: F.col("x") + e))
    found = base.join(errors, "tenant_id").select("tenant_id", "step", sorted_.alias("s"))
    return found.select("tenant_id", "step", *(F.element_at("s", i + 1).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def coverage(forecasts: DataFrame, actuals: DataFrame, last: int | None = None) -> DataFrame:
    """tenant_id and the share of actual values between p10 and p90 of the buckets that both have; of the last ones if asked."""
    matched = forecasts.join(actuals, ["tenant_id", "bucket"])
    if last:
        matched = matched.withColumn("_p", F.row_number().over(newest_first())).where(F.col("_p") <= last)
    return matched.groupBy("tenant_id").agg(F.avg(F.col("y").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), F.count("*").alias("n"))


def coverage_class(v: Column) -> Column:
    return F.when(v.isNull(), "ok").when((v < 0.65) | (v > 0.95), "alarm").when(F.abs(v - 0.8) > 0.08, "drifting").otherwise("ok")


def psi_class(v: Column) -> Column:
    return F.when(v.isNull(), "insufficient_data").when(v > 0.25, "alarm").when(v > 0.10, "drifting").otherwise("ok")


def worst_status(a: Column, b: Column) -> Column:
    order = ("insufficient_data", "ok", "drifting", "alarm")
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), c)
    return F.element_at(F.array(*map(F.lit, order)), F.greatest(rank(a), rank(b)).cast("int"))


def pinball(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """tenant_id and the mean pinball loss of each quantile."""
    joined = forecasts.join(actuals, ["tenant_id", "bucket"])
    loss = lambda q, c: F.avg(F.greatest(q * (F.col("y") - F.col(c)), (q - 1) * (F.col("y") - F.col(c))))
    return joined.groupBy("tenant_id").agg(loss(0.1, "p10").alias("loss_p10"), loss(0.5, "p50").alias("loss_p50"), loss(0.9, "p90").alias("loss_p90"))


def psi(values: DataFrame, bins: int = 10) -> DataFrame:
    """key, psi and bins from rows of key, recent (boolean) and x: how far the recent values' distribution has moved.

    Edges are the quantiles of the other values, as many as both sides have five values for; with fewer than two bins psi is null.
    """
    sizes = values.groupBy("key").agg(F.count_if("recent").alias("n_recent"), F.count_if(~F.col("recent")).alias("n_train"))
    usable = sizes.withColumn("bins", F.least(F.lit(bins), F.floor(F.least("n_recent", "n_train") / 5)).cast("int"))
    quantiles = values.where("NOT recent").groupBy("key").agg(*(F.percentile("x", F.array(*(F.lit(i / b) for i in range(1, b)))).alias(f"e{b}") for b in range(2, bins + 1)))
    joined = usable.join(quantiles, "key", "left")
    edges = F.coalesce(*(F.when(F.col("bins") == b, F.col(f"e{b}")) for b in range(2, bins + 1)))
    joined = joined.select("key", "bins", "n_recent", "n_train", edges.alias("edges"))
    placed = values.join(joined, "key").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x"))))
    counted = placed.where("bins >= 2").groupBy("key", "bin").agg(F.count_if("recent").alias("r"), F.count_if(~F.col("recent")).alias("t"))
    full = joined.where("bins >= 2").select("key", "n_recent", "n_train", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).join(counted, ["key", "bin"], "left")
    r = F.greatest(F.coalesce(F.col("r"), F.lit(0)) / F.col("n_recent"), F.lit(1e-6))
    t = F.greatest(F.coalesce(F.col("t"), F.lit(0)) / F.col("n_train"), F.lit(1e-6))
    moved = full.groupBy("key").agg(F.sum((r - t) * F.ln(r / t)).alias("psi"))
    return joined.select("key", "bins").join(moved, "key", "left")


def magnitude(sigma: Column) -> Column:
    x = F.abs(sigma)
    return F.when(x < 0.25, "holding steady").when(x < 0.75, "a slight move").when(x < 1.5, "a clear move").otherwise("a sharp move")


def narrative(target: Column, change: Column, band: Column, higher_is_worse: Column) -> Column:
    """One deterministic sentence on where a target is heading."""
    worse = F.when(F.abs(change) < 0.25, "").when(higher_is_worse == (change > 0), ", which is worse").otherwise(", which is better")
    sure = F.when(band < 1.0, "a narrow range").when(band < 2.0, "a moderate range").otherwise("a wide range")
    return F.concat(target, F.lit(": "), magnitude(change), F.when(change > 0, " up").when(change < 0, " down").otherwise(""), worse, F.lit(", with "), sure, F.lit("."))


# --- what drives a forecast -------------------------------------------------------------------------------------


def attention_drivers(weights: DataFrame, names: list[str], most: int = 8, places: int = 5) -> DataFrame:
    """key, rank, feature, weight: of each key's steps (key, weights) the features with the largest mean weight, ties by name; weights without a name count for nothing."""
    each = weights.select("key", F.posexplode("weights").alias("_i", "_w")).where(F.col("_i") < len(names))
    mean = each.groupBy("key", "_i").agg(F.avg("_w").alias("_mean"))
    named = mean.select("key", F.get(F.array(*map(F.lit, names)), F.col("_i")).alias("feature"), F.round("_mean", places).alias("weight"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "feature"))).where(F.col("rank") <= most)


def merged_drivers(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """key, rank, label, weight, share: sizes of weights (key, feature, weight) under one label (feature, label) together; features without a label are left out."""
    found = weights.join(labels, "feature").groupBy("key", "label").agg(F.sum(F.abs("weight")).alias("weight"))
    whole = F.sum("weight").over(Window.partitionBy("key"))
    return found.select("key", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "label")).alias("rank"), "label", "weight", F.when(whole > 0, F.col("weight") / whole).otherwise(0.0).alias("share"))


def has_signal(column: str) -> Column:
    """An aggregate: whether a column's finite values vary."""
    value = F.col(column).cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.coalesce(F.stddev_pop(finite) > 1e-9, F.lit(False))


def matrix_row(columns: list[str]) -> Column:
    """A row's features as an array of floats in the given order, zero for what is missing."""
    return F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float") for c in columns))


def covariate_code(value: Column, vocabulary: list[str]) -> Column:
    """The place of a value in its vocabulary from 1 on; 0 for none and unknown ones."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, vocabulary)), value), F.lit(0).cast("long"))


def covariate_value(code: Column, vocabulary: list[str]) -> Column:
    """The value of covariate_code(); null for 0 and for places that the vocabulary doesn't have."""
    return F.try_element_at(F.array(*map(F.lit, vocabulary)), F.when(code > 0, code.cast("int")))


def forecast_state(drift_alarm: Column, cold: Column, recent_events: Column) -> Column:
    """A forecast's state: an alarm counts before all, then a cold start, then whether anything came lately."""
    return F.when(drift_alarm, "error").when(cold, "cold").when(recent_events > 0, "active").otherwise("live")
