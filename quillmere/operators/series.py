"""Operators on ordered series: canonical events, deltas, momentum, after-hours heatmaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_events(streams: list[DataFrame]) -> DataFrame:
    """The union of streams by name; rows without a time go, a null actor becomes empty."""
    united = reduce(DataFrame.unionByName, streams)
    return united.where(F.col("ts").isNotNull()).withColumn("actor", F.coalesce("actor", F.lit("")))


def after_hours(events: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """tenant_id, band, day_col, n: activity outside working hours in the tenant's time zone.

    Band 0 is 18 to 21 o'clock, band 1 from 21 to 6. Columns 1 to 5 are Monday to Friday, 6 the weekend, whose daytime counts in band 0;
    that of weekdays isn't counted.
    """
    local = events.select("tenant_id", (F.col("ts") + F.make_dt_interval(mins=F.lit(offset_minutes))).alias("t"))
    hour, dow = F.hour("t"), F.dayofweek("t") - 1
    counts = local.groupBy("tenant_id", dow.alias("dow"), hour.alias("hour")).agg(F.count("*").alias("n"))
    weekend = F.col("dow").isin(0, 6)
    band = F.when((F.col("hour") >= 21) | (F.col("hour") < 6), 1).when((F.col("hour") >= 18) | weekend, 0)
    banded = counts.select("tenant_id", band.alias("band"), F.when(weekend, 6).otherwise(F.col("dow")).alias("day_col"), "n").where("band IS NOT NULL")
    return banded.groupBy("tenant_id", "band", "day_col").agg(F.sum("n").alias("n"))


def hotspot(heat: DataFrame) -> DataFrame:
    """Each tenant's busiest cell; of equal ones the first by band and column."""
    best = F.max_by(F.struct("band", "day_col", "n"), F.struct("n", -F.col("band"), -F.col("day_col")))
    return heat.groupBy("tenant_id").agg(best.alias("b")).select("tenant_id", "b.band", "b.day_col", "b.n")


def deltas(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn("delta", F.col(column) - F.lag(column).over(Window.partitionBy("tenant_id").orderBy("bucket")))


def momentum(frame: DataFrame, needed: int = 3, most: int = 6) -> DataFrame:
    """Adds streak, the number of deltas of one sign up to here (of the last ``most``), and momentum: rising, falling or none. A zero ends a streak."""
    order = Window.partitionBy("tenant_id").orderBy("bucket")
    moved = frame.where("delta IS NOT NULL").withColumn("_sign", F.signum("delta"))
    broken = (F.col("_sign") == 0) | ~F.col("_sign").eqNullSafe(F.lag("_sign").over(order))
    islands = moved.withColumn("_broken", broken.cast("int")).withColumn("_island", F.sum("_broken").over(order))
    place = F.row_number().over(Window.partitionBy("tenant_id", "_island").orderBy("bucket"))
    streak = F.when(F.col("_sign") == 0, 0).otherwise(F.least(place, F.lit(most)))
    named = F.when((F.col("streak") >= needed) & (F.col("_sign") > 0), "rising").when((F.col("streak") >= needed) & (F.col("_sign") < 0), "falling").otherwise("none")
    return islands.withColumn("streak", streak.cast("long")).withColumn("momentum", named)


# --- weekly text features ---------------------------------------------------------------------------------------


def weekly_text(messages: DataFrame, window: int = 8) -> DataFrame:
    """tenant_id, week, sentiment_mean, sentiment_std, topic_drift of messages with sentiment and embedding.

    topic_drift is the cosine distance of a week's mean vector from a baseline of the weeks before it, which moves towards
    each week by one part in ``window``; a first week has none. Weeks, not messages, meet in a tenant's list.
    """
    keys = ["tenant_id", "week"]
    mood = messages.groupBy(*keys).agg(F.avg("sentiment").alias("sentiment_mean"), F.stddev_pop("sentiment").alias("sentiment_std"))
    parts = messages.select(*keys, F.posexplode("embedding").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    weeks = parts.groupBy(*keys).agg(centroid.alias("c")).groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("week", "c"))).alias("weeks"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def drift(c: Column, b: Column) -> Column:
        length = lambda v: F.sqrt(dot(v, v)) + 1e-9
        return F.when(F.size(b) == 0, 0.0).otherwise(1 - dot(c, b) / (length(c) * length(b)))

    def step(acc: Column, w: Column) -> Column:
        moved = F.when(F.size(acc["base"]) == 0, w["c"]).otherwise(F.zip_with(acc["base"], w["c"], lambda b, c: b * (1 - 1 / window) + c * (1 / window)))
        row = F.struct(w["week"].alias("week"), drift(w["c"], acc["base"]).alias("topic_drift"))
        return F.struct(moved.alias("base"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.array().cast("array<double>").alias("base"), F.array().cast("array<struct<week:bigint,topic_drift:double>>").alias("rows"))
    folded = weeks.select("tenant_id", F.inline(F.aggregate("weeks", start, step, lambda acc: acc["rows"])))
    return mood.join(folded, keys, "left").select(*keys, "sentiment_mean", "sentiment_std", F.coalesce("topic_drift", F.lit(0.0)).alias("topic_drift"))
