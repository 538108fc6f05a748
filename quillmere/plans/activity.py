"""Queries on activity events: weekly features, unions of sources, heatmaps and streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import series, weekly
from quillmere.plans.registry import query
from quillmere.sources import tables
from quillmere.sources.tables import EVENTS_SQL

_BASE_SQL = """base AS (
  SELECT tenant_id, CAST(date_trunc('{unit}', ts) AS DATE) AS bucket,
    count(*) FILTER (kind = 'commit') AS n_commits, count(*) FILTER (kind = 'pr_opened') AS n_prs_opened, count(*) FILTER (kind = 'pr_merged') AS n_prs_merged,
    count(*) FILTER (kind = 'doc_created') AS n_docs_created, count(*) FILTER (kind = 'doc_edited') AS n_docs_edited, count(*) FILTER (kind = 'message') AS n_messages, count(*) FILTER (kind = 'task_assigned') AS n_tasks_assigned,
    count(*) FILTER (kind = 'task_completed') AS n_tasks_completed, count(*) FILTER (kind = 'task_reopened') AS n_tasks_reopened, count(*) FILTER (kind = 'decision') AS n_decisions,
    avg(CASE WHEN hour(ts) < 9 OR hour(ts) >= 18 THEN 1.0 ELSE 0.0 END) AS after_hours_ratio, avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend_ratio,
    coalesce(quantile_cont(review_delay_s, 0.5), 0.0) AS median_review_delay, coalesce(max(review_delay_s), 0.0) AS max_review_delay
  FROM ev GROUP BY ALL
),
by_actor AS (SELECT tenant_id, CAST(date_trunc('{unit}', ts) AS DATE) AS bucket, actor, count(*) AS c FROM ev GROUP BY ALL),
shares AS (SELECT *, c / sum(c) OVER (PARTITION BY tenant_id, bucket) AS p FROM by_actor),
disp AS (SELECT tenant_id, bucket, count(*) AS active_actors, max(p) AS top_actor_share, -sum(p * ln(p + 1e-9)) AS actor_entropy FROM shares GROUP BY ALL)"""

_WEEKLY_SQL = f"""WITH {EVENTS_SQL}, {_BASE_SQL.format(unit="week")},
span AS (SELECT tenant_id, min(bucket) AS a, max(bucket) AS b FROM base GROUP BY tenant_id),
grid AS (SELECT tenant_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS bucket FROM span),
full_ AS (SELECT g.tenant_id, g.bucket, base.* EXCLUDE (tenant_id, bucket), active_actors, top_actor_share, actor_entropy, CASE WHEN base.bucket IS NULL THEN 0 ELSE 1 END AS observed
          FROM grid g LEFT JOIN base ON g.tenant_id = base.tenant_id AND g.bucket = base.bucket LEFT JOIN disp ON g.tenant_id = disp.tenant_id AND g.bucket = disp.bucket),
isl AS (SELECT *, sum(observed) OVER (PARTITION BY tenant_id ORDER BY bucket) AS island FROM full_)"""


@query(
    f"""{_WEEKLY_SQL}
SELECT tenant_id, bucket, n_docs_created, n_docs_edited, n_messages, n_tasks_assigned, n_tasks_completed, n_tasks_reopened, n_decisions,
  round(after_hours_ratio, 6) AS after_hours_ratio, round(weekend_ratio, 6) AS weekend_ratio, round(median_review_delay, 6) AS median_review_delay, round(max_review_delay, 6) AS max_review_delay,
  CASE WHEN observed = 1 THEN round(CASE WHEN n_tasks_assigned = 0 THEN 0.0 ELSE n_tasks_completed / n_tasks_assigned END, 6) END AS completion_rate,
  active_actors, round(top_actor_share, 6) AS top_actor_share, round(actor_entropy, 6) AS actor_entropy, observed,
  CAST(sum(1 - observed) OVER (PARTITION BY tenant_id, island ORDER BY bucket) AS BIGINT) AS weeks_since_last_event
FROM isl"""
)
def weekly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weekly.weekly_features(tables.activity_events(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("after_hours_ratio", "weekend_ratio", "median_review_delay", "max_review_delay", "completion_rate", "top_actor_share", "actor_entropy")]
    counts = ["n_docs_created", "n_docs_edited", "n_messages", "n_tasks_assigned", "n_tasks_completed", "n_tasks_reopened", "n_decisions", "active_actors", "observed", "weeks_since_last_event"]
    return found.select("tenant_id", "bucket", *counts, *rounded)


_GAPS_SQL = f"""WITH {EVENTS_SQL}, kept AS (SELECT * FROM ev WHERE CAST(date_trunc('week', ts) AS DATE) NOT IN (DATE '2024-01-08', DATE '2024-01-15') OR tenant_id > 0),
w AS (SELECT tenant_id, CAST(date_trunc('week', ts) AS DATE) AS bucket, count(*) AS n FROM kept GROUP BY ALL),
span AS (SELECT tenant_id, min(bucket) AS a, max(bucket) AS b FROM w GROUP BY tenant_id),
grid AS (SELECT tenant_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS bucket FROM span),
f AS (SELECT g.tenant_id, g.bucket, n, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS observed FROM grid g LEFT JOIN w USING (tenant_id, bucket)),
isl AS (SELECT *, sum(observed) OVER (PARTITION BY tenant_id ORDER BY bucket) AS island FROM f)
SELECT tenant_id, bucket, n, observed, CAST(sum(1 - observed) OVER (PARTITION BY tenant_id, island ORDER BY bucket) AS BIGINT) AS weeks_since_last_event FROM isl"""


@query(_GAPS_SQL)
def weekly_grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of one tenant are left out, so that the grid has a gap to fill."""
    events = tables.activity_events(spark, sf_dir)
    week = weekly.bucket_of(F.col("ts"), "WEEK")
    kept = events.where(~week.isin(F.lit("2024-01-08").cast("date"), F.lit("2024-01-15").cast("date")) | (F.col("tenant_id") > 0))
    counts = kept.groupBy("tenant_id", weekly.bucket_of(F.col("ts"), "WEEK").alias("bucket")).agg(F.count("*").alias("n"))
    return weekly.since_last_event(weekly.grid(counts)).select("tenant_id", "bucket", "n", "observed", "weeks_since_last_event")


@query(
    f"""WITH {EVENTS_SQL}, d AS (SELECT tenant_id, CAST(ts AS DATE) AS bucket, count(*) FILTER (kind = 'task_reopened' AND review_delay_s > 97) AS hits FROM ev GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id ORDER BY bucket) AS island FROM d)
SELECT tenant_id, bucket, hits, CAST(row_number() OVER (PARTITION BY tenant_id, island ORDER BY bucket) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS BIGINT) AS since_hit FROM i"""
)
def since_last_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since a tenant's last slow reopened task; the first days count from one."""
    hit = (F.col("kind") == "task_reopened") & (F.col("review_delay_s") > 97)
    days = tables.activity_events(spark, sf_dir).groupBy("tenant_id", F.to_date("ts").alias("bucket")).agg(F.count_if(hit).alias("hits"))
    return weekly.since_nonzero(days, "hits", "since_hit")


@query(
    f"""WITH {EVENTS_SQL}
SELECT 'activity' AS stream, kind, count(*) AS n, count(DISTINCT actor) AS actors, min(ts) AS first_ts FROM ev GROUP BY kind
UNION ALL SELECT 'orders', CASE o_orderstatus WHEN 'F' THEN 'task_completed' ELSE 'task_assigned' END AS kind, count(*), count(DISTINCT o_custkey), min(o_orderdate) FROM orders GROUP BY 2"""
)
def event_union_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources in the canonical shape (ts, actor, kind), united, then counted by kind."""
    kind = F.when(F.col("o_orderstatus") == "F", "task_completed").otherwise("task_assigned")
    orders = tables.table(spark, sf_dir, "orders").select(F.lit("orders").alias("stream"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_custkey").cast("string").alias("actor"), kind.alias("kind"))
    own = tables.activity_events(spark, sf_dir).select(F.lit("activity").alias("stream"), "ts", "actor", "kind")
    canonical = series.canonical_events([own, orders])
    return canonical.groupBy("stream", "kind").agg(F.count("*").alias("n"), F.countDistinct("actor").alias("actors"), F.min("ts").alias("first_ts"))


@query("SELECT DISTINCT tenant FROM (SELECT CAST(user_id % 5 AS VARCHAR) AS tenant FROM events UNION SELECT CAST(o_custkey % 20 AS VARCHAR) FROM orders) WHERE tenant <> ''")
def tenant_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.activity_events(spark, sf_dir).select(F.col("tenant_id").cast("string").alias("tenant"))
    b = tables.credit_ledger(spark, sf_dir).select(F.col("tenant_id").cast("string").alias("tenant"))
    return a.union(b).where("tenant <> ''").distinct()


_HEAT_SQL = f"""WITH {EVENTS_SQL}, s AS (SELECT tenant_id, ts + INTERVAL 60 MINUTE AS t FROM ev),
c AS (SELECT tenant_id, CAST(extract(dow FROM t) AS INTEGER) AS dow, hour(t) AS hour, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT tenant_id, CASE WHEN dow IN (0, 6) THEN 6 ELSE dow END AS day_col, CASE WHEN hour >= 21 OR hour < 6 THEN 1 WHEN hour >= 18 OR dow IN (0, 6) THEN 0 END AS band, n FROM c),
h AS (SELECT tenant_id, band, day_col, CAST(sum(n) AS BIGINT) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL)"""


@query(f"{_HEAT_SQL} SELECT tenant_id, band, day_col, n FROM h")
def after_hours_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.after_hours(tables.activity_events(spark, sf_dir), 60)


@query(f"{_HEAT_SQL} SELECT tenant_id, band, day_col, n FROM h QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, band, day_col) = 1")
def heatmap_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hotspot(series.after_hours(tables.activity_events(spark, sf_dir), 60))


_DAILY_SQL = f"{EVENTS_SQL}, d AS (SELECT tenant_id, CAST(ts AS DATE) AS bucket, CAST(count(*) AS DOUBLE) AS x FROM ev GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.activity_events(spark, sf_dir).groupBy("tenant_id", F.to_date("ts").alias("bucket")).agg(F.count("*").cast("double").alias("x"))


@query(f"WITH {_DAILY_SQL} SELECT tenant_id, bucket, x, x - lag(x) OVER (PARTITION BY tenant_id ORDER BY bucket) AS delta FROM d")
def weekly_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.deltas(_daily(spark, sf_dir), "x")


@query(
    f"""WITH {_DAILY_SQL}, l AS (SELECT tenant_id, bucket, x - lag(x) OVER (PARTITION BY tenant_id ORDER BY bucket) AS delta FROM d),
s AS (SELECT *, sign(delta) AS sg, CASE WHEN sign(delta) = 0 OR sign(delta) IS DISTINCT FROM sign(lag(delta) OVER (PARTITION BY tenant_id ORDER BY bucket)) THEN 1 ELSE 0 END AS brk FROM l WHERE delta IS NOT NULL),
i AS (SELECT *, sum(brk) OVER (PARTITION BY tenant_id ORDER BY bucket) AS island FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, island ORDER BY bucket) AS pos FROM i)
SELECT tenant_id, bucket, delta, CASE WHEN sg = 0 THEN 0 ELSE least(pos, 6) END AS streak,
       CASE WHEN sg <> 0 AND least(pos, 6) >= 3 THEN CASE WHEN sg > 0 THEN 'rising' ELSE 'falling' END ELSE 'none' END AS momentum FROM r"""
)
def momentum_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.momentum(series.deltas(_daily(spark, sf_dir), "x")).select("tenant_id", "bucket", "delta", "streak", "momentum")


@query(
    """SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, GROUPING(CAST(date_trunc('day', ts) AS DATE)) AS g_day, GROUPING(event_type) AS g_type
FROM events GROUP BY ROLLUP (CAST(date_trunc('day', ts) AS DATE), event_type)"""
)
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets, which Spark brings with it."""
    events = tables.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return events.rollup("day", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping("day").cast("long").alias("g_day"), F.grouping("event_type").cast("long").alias("g_type")
    )


@query(
    """SELECT n_name, p_brand, count(*) AS n, GROUPING(n_name) AS g_nation, GROUPING(p_brand) AS g_brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY CUBE (n_name, p_brand)"""
)
def usage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: tables.table(spark, sf_dir, name)
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.cube("n_name", "p_brand").agg(F.count("*").alias("n"), F.grouping("n_name").cast("long").alias("g_nation"), F.grouping("p_brand").cast("long").alias("g_brand"))


@query(
    """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after thirty minutes without an event."""
    events = tables.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("SELECT approx_bucket AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS approx_bucket, value FROM events) GROUP BY 1")
def tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    found = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "mean")


