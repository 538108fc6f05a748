"""Weekly (or daily) activity features: conditional counts, ratios, dispersion, complete grids and run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The kinds that are counted, with the names of their features.
COUNTED = {
    "commit": "n_commits", "pr_opened": "n_prs_opened", "pr_merged": "n_prs_merged", "doc_created": "n_docs_created", "doc_edited": "n_docs_edited", "message": "n_messages",
    "task_assigned": "n_tasks_assigned", "task_completed": "n_tasks_completed", "task_reopened": "n_tasks_reopened", "decision": "n_decisions",
}


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bucket_of(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("date")


def base_features(events: DataFrame, unit: str = "WEEK") -> DataFrame:
    """tenant_id, bucket and the features that one aggregation gives; unit is WEEK (from Monday) or DAY."""
    hour, day = F.hour("ts"), F.weekday("ts")
    counted = [F.count_if(F.col("kind") == k).alias(name) for k, name in COUNTED.items()]
    found = events.groupBy("tenant_id", bucket_of(F.col("ts"), unit).alias("bucket")).agg(
        *counted,
        F.avg(((hour < 9) | (hour >= 18)).cast("double")).alias("after_hours_ratio"),
        F.avg((day >= 5).cast("double")).alias("weekend_ratio"),
        F.coalesce(F.median("review_delay_s"), F.lit(0.0)).alias("median_review_delay"),
        F.coalesce(F.max("review_delay_s"), F.lit(0.0)).alias("max_review_delay"),
    )
    return (
        found.withColumn("merge_rate", safe_ratio(F.col("n_prs_merged"), F.col("n_prs_opened")))
        .withColumn("completion_rate", safe_ratio(F.col("n_tasks_completed"), F.col("n_tasks_assigned")))
        .withColumn("reopen_rate", safe_ratio(F.col("n_tasks_reopened"), F.col("n_tasks_completed")))
    )


def dispersion(events: DataFrame, unit: str = "WEEK") -> DataFrame:
    """tenant_id, bucket, active_actors, top_actor_share and actor_entropy (natural logarithm).

    Counts each actor first, and sums of those counts next, so that neither stage gathers a tenant's events.
    """
    key = ["tenant_id", "bucket"]
    by_actor = events.groupBy("tenant_id", bucket_of(F.col("ts"), unit).alias("bucket"), "actor").agg(F.count("*").alias("c"))
    totals = by_actor.groupBy(*key).agg(F.sum("c").alias("total"))
    share = F.col("c") / F.col("total")
    return by_actor.join(totals, key).groupBy(*key).agg(
        F.count("*").alias("active_actors"), F.max(share).alias("top_actor_share"), (-F.sum(share * F.ln(share + 1e-9))).alias("actor_entropy")
    )


def grid(frame: DataFrame, days: int = 7) -> DataFrame:
    """Every bucket from a tenant's first to its last, with observed (1 or 0); other columns are null in gaps."""
    span = frame.groupBy("tenant_id").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    full = span.select("tenant_id", F.explode(F.expr(f"sequence(a, b, interval {days} days)")).alias("bucket"))
    return full.join(frame.withColumn("observed", F.lit(1)), ["tenant_id", "bucket"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))


def since_last_event(frame: DataFrame) -> DataFrame:
    """Adds weeks_since_last_event, the length of the run of unobserved buckets up to this one."""
    order = Window.partitionBy("tenant_id").orderBy("bucket")
    island = F.sum("observed").over(order)
    run = F.sum(1 - F.col("observed")).over(Window.partitionBy("tenant_id", "_island").orderBy("bucket"))
    return frame.withColumn("_island", island).withColumn("weeks_since_last_event", run).drop("_island")


def since_nonzero(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the number of buckets since column was above zero: 0 there, and from 1 on before the first."""
    order = Window.partitionBy("tenant_id").orderBy("bucket")
    hit = (F.coalesce(F.col(column), F.lit(0)) > 0).cast("long")
    place = F.row_number().over(Window.partitionBy("tenant_id", "_island").orderBy("bucket"))
    return frame.withColumn("_island", F.sum(hit).over(order)).withColumn(name, (place - F.when(F.col("_island") > 0, 1).otherwise(0)).cast("long")).drop("_island")


def weekly_features(events: DataFrame, unit: str = "WEEK") -> DataFrame:
    """The feature table: base features and dispersion on a complete grid, with the run of empty buckets."""
    joined = base_features(events, unit).join(dispersion(events, unit), ["tenant_id", "bucket"])
    return since_last_event(grid(joined, 7 if unit == "WEEK" else 1))
