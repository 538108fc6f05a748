"""Queries on forecasts. The driver's events span thirty days, so that buckets are days here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators import forecast
from quillmere.plans.registry import query
from quillmere.sources import tables
from quillmere.sources.tables import EVENTS_SQL

_DAYS_SQL = f"""{EVENTS_SQL}, d AS (SELECT tenant_id, CAST(ts AS DATE) AS bucket, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN hour(ts) < 9 OR hour(ts) >= 18 THEN 1.0 ELSE 0.0 END) AS after_hours FROM ev GROUP BY ALL)"""
_COLUMNS = {"n": True, "after_hours": False}
_TRAIN_END = "2024-01-24"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return tables.activity_events(spark, sf_dir).groupBy("tenant_id", F.to_date("ts").alias("bucket")).agg(
        F.count("*").cast("double").alias("n"), F.avg(((hour < 9) | (hour >= 18)).cast("double")).alias("after_hours")
    )


_LONG_SQL = f"{_DAYS_SQL}, lg AS (SELECT tenant_id, bucket, 'n' AS feature, ln(1 + greatest(n, 0)) AS x FROM d UNION ALL SELECT tenant_id, bucket, 'after_hours', after_hours FROM d), st AS (SELECT tenant_id, feature, avg(x) AS mean, stddev_samp(x) AS std FROM lg WHERE bucket <= DATE '{_TRAIN_END}' GROUP BY ALL)"


@query(f"WITH {_LONG_SQL} SELECT tenant_id, feature, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def norm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecast.fit_normaliser(_days(spark, sf_dir), _COLUMNS, F.lit(_TRAIN_END).cast("date"))
    return found.select("tenant_id", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    f"""WITH {_LONG_SQL} SELECT tenant_id, bucket, feature, round(coalesce((x - mean) / (std + 1e-6), 0), 5) AS z, round(sin(2 * pi() * weekofyear(bucket) / 52), 6) AS week_sin, round(cos(2 * pi() * weekofyear(bucket) / 52), 6) AS week_cos
FROM lg JOIN st USING (tenant_id, feature)"""
)
def norm_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    found = forecast.normalise(days, forecast.fit_normaliser(days, _COLUMNS, F.lit(_TRAIN_END).cast("date")), _COLUMNS)
    return found.select("tenant_id", "bucket", "feature", F.round("z", 5).alias("z"), F.round("week_sin", 6).alias("week_sin"), F.round("week_cos", 6).alias("week_cos"))


@query(
    f"""WITH {_DAYS_SQL}, w AS (SELECT tenant_id, bucket, list(n) OVER (PARTITION BY tenant_id ORDER BY bucket ROWS 4 PRECEDING) AS past, list(n) OVER (PARTITION BY tenant_id ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS coming FROM d)
SELECT tenant_id, bucket, array_to_string(list_transform(past, lambda x: CAST(x AS BIGINT)), ' ') AS past, array_to_string(list_transform(coming, lambda x: CAST(x AS BIGINT)), ' ') AS coming FROM w WHERE len(past) = 5 AND len(coming) = 2"""
)
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecast.windows(_days(spark, sf_dir), "n", 5, 2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ")
    return found.select("tenant_id", "bucket", text("past").alias("past"), text("coming").alias("coming"))


@query(f"WITH {_DAYS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY bucket DESC) AS p FROM d) SELECT tenant_id, bucket, p > 7 AS in_train, p <= 17 AS in_validation FROM p")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.split(_days(spark, sf_dir), 7, 10).select("tenant_id", "bucket", "in_train", "in_validation")


@query(
    f"""WITH {_DAYS_SQL}, l AS (SELECT tenant_id, list(CAST(n AS BIGINT) ORDER BY bucket) AS v FROM d GROUP BY tenant_id)
SELECT tenant_id, array_to_string(list_concat(list_transform(generate_series(1, 40 - len(v)), lambda x: CAST(0 AS BIGINT)), v), ' ') AS past FROM l"""
)
def lookback_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecast.padded(_days(spark, sf_dir), "n", 40)
    return found.select("tenant_id", F.array_join(F.transform("window", lambda x: x.cast("long").cast("string")), " ").alias("past"))


_NAIVE_SQL = f"""{_DAYS_SQL}, h AS (SELECT * FROM d WHERE bucket <= DATE '{_TRAIN_END}'),
e AS (SELECT tenant_id, n - lag(n, 7) OVER (PARTITION BY tenant_id ORDER BY bucket) AS e FROM h), q AS (SELECT tenant_id, quantile_cont(e, [0.1, 0.5, 0.9]) AS q FROM e WHERE e IS NOT NULL GROUP BY tenant_id),
l AS (SELECT tenant_id, n AS x, 8 - row_number() OVER (PARTITION BY tenant_id ORDER BY bucket DESC) AS step FROM h),
f AS (SELECT l.tenant_id, step, list_sort(list_transform(q, lambda e: x + e)) AS s FROM l JOIN q ON l.tenant_id = q.tenant_id WHERE step >= 1 AND step <= 6),
fc AS (SELECT tenant_id, DATE '{_TRAIN_END}' + CAST(step AS INTEGER) AS bucket, step, s[1] AS p10, s[2] AS p50, s[3] AS p90 FROM f)"""


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _days(spark, sf_dir).where(F.col("bucket") <= F.lit(_TRAIN_END).cast("date"))
    found = forecast.naive_quantiles(history, "n", 7, 6)
    return found.withColumn("bucket", F.date_add(F.lit(_TRAIN_END).cast("date"), F.col("step").cast("int")))


@query(f"WITH {_NAIVE_SQL} SELECT tenant_id, bucket, CAST(step AS BIGINT) AS step, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM fc")
def naive_quantile_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _forecasts(spark, sf_dir)
    return found.select("tenant_id", "bucket", F.col("step").cast("long").alias("step"), *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")))


_ACTUAL_SQL = f"{_NAIVE_SQL}, m AS (SELECT fc.*, d.n AS y FROM fc JOIN d ON fc.tenant_id = d.tenant_id AND fc.bucket = d.bucket)"


def _actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("tenant_id", "bucket", F.col("n").alias("y"))


@query(
    f"""WITH {_ACTUAL_SQL}, lm AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY bucket DESC) <= 4), c AS (SELECT tenant_id, avg(CASE WHEN y BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n FROM lm GROUP BY tenant_id)
SELECT tenant_id, round(coverage, 6) AS coverage, n, CASE WHEN coverage < 0.65 OR coverage > 0.95 THEN 'alarm' WHEN abs(coverage - 0.8) > 0.08 THEN 'drifting' ELSE 'ok' END AS status FROM c"""
)
def coverage_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecast.coverage(_forecasts(spark, sf_dir), _actuals(spark, sf_dir), 4)
    return found.select("tenant_id", F.round("coverage", 6).alias("coverage"), "n", forecast.coverage_class(F.col("coverage")).alias("status"))


@query(
    f"""WITH {_ACTUAL_SQL} SELECT tenant_id, {", ".join(f"round(avg(greatest({q} * (y - {c}), ({q} - 1) * (y - {c}))), 6) AS loss_{c}" for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))} FROM m GROUP BY tenant_id"""
)
def pinball_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forecast.pinball(_forecasts(spark, sf_dir), _actuals(spark, sf_dir))
    return found.select("tenant_id", *(F.round(c, 6).alias(c) for c in ("loss_p10", "loss_p50", "loss_p90")))


_PSI_ROWS_SQL = f"""{_DAYS_SQL}, v AS (SELECT 't' || tenant_id || ':' || k AS key, bucket > DATE '2024-01-17' AS recent, x FROM (SELECT tenant_id, bucket, 'n' AS k, n AS x FROM d UNION ALL SELECT tenant_id, bucket, 'after_hours', after_hours FROM d)),
s AS (SELECT key, count(*) FILTER (recent) AS nr, count(*) FILTER (NOT recent) AS nt, CAST(least(10, floor(least(count(*) FILTER (recent), count(*) FILTER (NOT recent)) / 5)) AS INTEGER) AS bins FROM v GROUP BY key),
ed AS (SELECT v.key, bins, nr, nt, quantile_cont(x, 0.5) FILTER (NOT recent) AS e FROM v JOIN s USING (key) GROUP BY ALL),
b AS (SELECT v.key, nr, nt, CASE WHEN e < x THEN 1 ELSE 0 END AS bin, recent FROM v JOIN ed USING (key) WHERE bins >= 2),
c AS (SELECT key, nr, nt, bin, greatest(count(*) FILTER (recent) / nr, 1e-6) AS r, greatest(count(*) FILTER (NOT recent) / nt, 1e-6) AS t FROM b GROUP BY key, nr, nt, bin),
ps AS (SELECT key, sum((r - t) * ln(r / t)) AS psi FROM c GROUP BY key)"""


def _psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("x")) for c in _COLUMNS))
    rows = _days(spark, sf_dir).select("tenant_id", "bucket", F.explode(values).alias("v"))
    keyed = rows.select(F.concat(F.lit("t"), "tenant_id", F.lit(":"), "v.k").alias("key"), (F.col("bucket") > F.lit("2024-01-17").cast("date")).alias("recent"), F.col("v.x").alias("x"))
    return forecast.psi(keyed)


@query(f"WITH {_PSI_ROWS_SQL} SELECT s.key, bins, round(psi, 6) AS psi FROM s LEFT JOIN ps ON s.key = ps.key")
def psi_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen recent days against seventeen before give two bins."""
    return _psi(spark, sf_dir).select("key", "bins", F.round("psi", 6).alias("psi"))


@query(
    f"""WITH {_PSI_ROWS_SQL}, w AS (SELECT split_part(key, ':', 1) AS tenant, arg_max(key, psi) AS worst, max(psi) AS psi FROM ps GROUP BY 1)
SELECT tenant, worst, round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'alarm' WHEN psi > 0.10 THEN 'drifting' ELSE 'ok' END AS status FROM w"""
)
def worst_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _psi(spark, sf_dir).where("psi IS NOT NULL").groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("tenant"))
    found = found.agg(F.max_by("key", "psi").alias("worst"), F.max("psi").alias("psi"))
    return found.select("tenant", "worst", F.round("psi", 6).alias("psi"), forecast.psi_class(F.col("psi")).alias("status"))


@query(
    f"""WITH {_DAYS_SQL}, b AS (SELECT tenant_id, bucket, n, avg(n) OVER w AS mean, count(*) OVER w AS seen, after_hours FROM d WINDOW w AS (PARTITION BY tenant_id ORDER BY bucket ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
s AS (SELECT tenant_id, bucket, CASE WHEN seen < 4 THEN 'insufficient_data' WHEN abs(n - mean) > 0.2 * mean THEN 'alarm' WHEN abs(n - mean) > 0.1 * mean THEN 'drifting' ELSE 'ok' END AS coverage,
  CASE WHEN after_hours > 0.7 THEN 'alarm' WHEN after_hours > 0.6 THEN 'drifting' WHEN n < 2 THEN 'insufficient_data' ELSE 'ok' END AS stability FROM b)
SELECT tenant_id, bucket, coverage, stability, ['insufficient_data', 'ok', 'drifting', 'alarm'][greatest(list_position(['insufficient_data', 'ok', 'drifting', 'alarm'], coverage), list_position(['insufficient_data', 'ok', 'drifting', 'alarm'], stability))] AS status FROM s"""
)
def drift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenant's day two statuses, of its events against the eight days before and of its work after hours, and the worse of them."""
    before = Window.partitionBy("tenant_id").orderBy("bucket").rowsBetween(-8, -1)
    days = _days(spark, sf_dir).withColumn("mean", F.avg("n").over(before)).withColumn("seen", F.count("*").over(before))
    off = F.abs(F.col("n") - F.col("mean"))
    coverage = F.when(F.col("seen") < 4, "insufficient_data").when(off > 0.2 * F.col("mean"), "alarm").when(off > 0.1 * F.col("mean"), "drifting").otherwise("ok")
    hours = F.col("after_hours")
    stability = F.when(hours > 0.7, "alarm").when(hours > 0.6, "drifting").when(F.col("n") < 2, "insufficient_data").otherwise("ok")
    found = days.select("tenant_id", "bucket", coverage.alias("coverage"), stability.alias("stability"))
    return found.withColumn("status", forecast.worst_status(F.col("coverage"), F.col("stability")))


@query(f"WITH {_NAIVE_SQL}, h4 AS (SELECT tenant_id, median(n) AS med FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY bucket DESC) <= 4) GROUP BY tenant_id) SELECT fc.tenant_id, round(p50 - med, 6) AS change FROM fc JOIN h4 ON fc.tenant_id = h4.tenant_id WHERE step = 6")
def median_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _days(spark, sf_dir).where(F.col("bucket") <= F.lit(_TRAIN_END).cast("date"))
    last = history.withColumn("p", F.row_number().over(forecast.newest_first())).where("p <= 4").groupBy("tenant_id").agg(F.median("n").alias("med"))
    return _forecasts(spark, sf_dir).where("step = 6").join(last, "tenant_id").select("tenant_id", F.round(F.col("p50") - F.col("med"), 6).alias("change"))


@query(f"WITH {_NAIVE_SQL} SELECT tenant_id, CAST(step AS BIGINT) AS step, round(p90 - p10, 6) AS width, round((p90 - p10) / nullif(abs(p50), 0), 6) AS relative FROM fc")
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.col("p90") - F.col("p10")
    return _forecasts(spark, sf_dir).select("tenant_id", F.col("step").cast("long").alias("step"), F.round(width, 6).alias("width"), F.round(width / F.nullif(F.abs("p50"), F.lit(0.0)), 6).alias("relative"))


@query(
    f"""WITH {_LONG_SQL}, z AS (SELECT tenant_id, bucket, (x - mean) / (std + 1e-6) AS z FROM lg JOIN st USING (tenant_id, feature) WHERE feature = 'n'),
c AS (SELECT tenant_id, arg_max(z, bucket) - arg_max(z, bucket) FILTER (bucket <= DATE '2024-01-23') AS change FROM z GROUP BY tenant_id)
SELECT tenant_id, 'velocity: ' || CASE WHEN abs(change) < 0.25 THEN 'holding steady' WHEN abs(change) < 0.75 THEN 'a slight move' WHEN abs(change) < 1.5 THEN 'a clear move' ELSE 'a sharp move' END || CASE WHEN change > 0 THEN ' up' WHEN change < 0 THEN ' down' ELSE '' END
  || CASE WHEN abs(change) < 0.25 THEN '' WHEN change < 0 THEN ', which is worse' ELSE ', which is better' END || ', with a moderate range.' AS sentence FROM c"""
)
def narrative_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    z = forecast.normalise(days, forecast.fit_normaliser(days, _COLUMNS, F.lit(_TRAIN_END).cast("date")), _COLUMNS).where("feature = 'n'")
    early = F.max_by("z", F.when(F.col("bucket") <= F.lit("2024-01-23").cast("date"), F.col("bucket")))
    change = z.groupBy("tenant_id").agg((F.max_by("z", "bucket") - early).alias("change"))
    return change.select("tenant_id", forecast.narrative(F.lit("velocity"), F.col("change"), F.lit(1.5), F.lit(False)).alias("sentence"))


@query(f"WITH {_DAYS_SQL}, t AS (SELECT tenant_id, avg(n) AS target FROM d GROUP BY tenant_id) SELECT d.tenant_id, arg_min(bucket, round(abs(n - target), 6) * 100000 + date_diff('day', DATE '2024-01-01', bucket)) AS bucket, round(min(abs(n - target)), 6) AS distance FROM d JOIN t ON d.tenant_id = t.tenant_id GROUP BY d.tenant_id")
def nearest_anchor_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day whose value is nearest to the mean; of equal ones the first."""
    days = _days(spark, sf_dir)
    target = days.groupBy("tenant_id").agg(F.avg("n").alias("target"))
    away = F.round(F.abs(F.col("n") - F.col("target")), 6)
    return days.join(target, "tenant_id").groupBy("tenant_id").agg(F.min_by("bucket", F.struct(away, "bucket")).alias("bucket"), F.min(away).alias("distance"))


@query(
    """WITH g(country, year, v) AS (VALUES (0, 1996, 1.5), (0, 1998, 2.5), (1, 1997, 3.5), (2, 1999, 4.5)), w AS (SELECT DISTINCT c_nationkey % 3 AS country, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT country, arg_max(v, year) AS latest FROM g GROUP BY country) SELECT w.country, week, coalesce(g.v, latest) AS v FROM w LEFT JOIN g ON w.country = g.country AND year(week) = g.year LEFT JOIN l ON w.country = l.country"""
)
def geo_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country's yearly value for each week: that of the week's year, else the latest year's."""
    values = spark.createDataFrame([(0, 1996, 1.5), (0, 1998, 2.5), (1, 1997, 3.5), (2, 1999, 4.5)], "country int, year int, v double")
    orders, customers = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "customer")
    weeks = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_nationkey") % 3).alias("country"), F.date_trunc("WEEK", "o_orderdate").cast("date").alias("week")).distinct()
    latest = values.groupBy("country").agg(F.max_by("v", "year").alias("latest"))
    own = weeks.withColumn("year", F.year("week")).join(F.broadcast(values), ["country", "year"], "left").join(F.broadcast(latest), "country", "left")
    return own.select("country", "week", F.coalesce("v", "latest").alias("v"))


@query(
    """WITH h(day) AS (VALUES (DATE '1996-12-25'), (DATE '1997-01-01'), (DATE '1997-05-01'), (DATE '1998-12-25')), w AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders)
SELECT week, count(day) AS holidays, month(week + 6) IN (3, 6, 9, 12) AND month(week + 6) <> month(week + 13) AS quarter_end FROM w LEFT JOIN h ON day BETWEEN week AND week + 6 GROUP BY week"""
)
def holiday_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays in each week, joined on the week that a holiday falls in rather than by range."""
    days = spark.createDataFrame([("1996-12-25",), ("1997-01-01",), ("1997-05-01",), ("1998-12-25",)], "day string").select(F.date_trunc("WEEK", F.col("day").cast("date")).cast("date").alias("week"))
    weeks = tables.table(spark, sf_dir, "orders").select(F.date_trunc("WEEK", "o_orderdate").cast("date").alias("week")).distinct()
    counted = weeks.join(F.broadcast(days.groupBy("week").agg(F.count("*").alias("holidays"))), "week", "left")
    month = lambda n: F.month(F.date_add("week", n))
    return counted.select("week", F.coalesce("holidays", F.lit(0)).alias("holidays"), (month(6).isin(3, 6, 9, 12) & (month(6) != month(13))).alias("quarter_end"))


@query(
    f"""WITH {_DAYS_SQL}, a AS (SELECT n AS x, count(*) FILTER (bucket <= DATE '2024-01-15') AS a, count(*) FILTER (bucket > DATE '2024-01-15') AS b FROM d GROUP BY n),
c AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM a) SELECT round(max(abs(fa - fb)), 6) AS ks FROM c"""
)
def ks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest distance between two distributions, over the distinct values of both."""
    early = F.col("bucket") <= F.lit("2024-01-15").cast("date")
    counts = _days(spark, sf_dir).groupBy(F.col("n").alias("x")).agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    # Days of tenants: a few values. For wide columns, take them in bins first.
    order, whole = Window.orderBy("x"), Window.partitionBy()
    share = lambda c: F.sum(c).over(order) / F.sum(c).over(whole)
    return counts.select(F.abs(share("a") - share("b")).alias("d")).agg(F.round(F.max("d"), 6).alias("ks"))




_STEPS = [f"feature_{i:02d}" for i in range(20)]


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("key"), F.transform("embedding", lambda v: v.cast("double")).alias("weights"))


@query(
    """WITH w AS (SELECT vec_id % 50 AS key, unnest(range(20)) AS i, CAST(unnest(embedding[1:20]) AS DOUBLE) AS w FROM embeddings), m AS (SELECT key, 'feature_' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, round(avg(w), 5) AS weight FROM w GROUP BY ALL)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY weight DESC, feature) AS rank, feature, weight FROM m QUALIFY rank <= 8"""
)
def attention_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the attention of steps, fifty sequences; the first twenty places have names."""
    found = forecast.attention_drivers(_steps(spark, sf_dir), _STEPS)
    return found.select("key", F.col("rank").cast("long").alias("rank"), "feature", "weight")


@query(
    """WITH m AS (SELECT l_suppkey AS key, CASE WHEN l_linenumber IN (1, 2) THEN 'Season' WHEN l_linenumber = 3 THEN 'Reviews' WHEN l_linenumber = 4 THEN 'Meetings' END AS label, sum(abs(l_quantity - 25)) AS weight FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY weight DESC, label) AS rank, label, CAST(weight AS DOUBLE) AS weight, CASE WHEN sum(weight) OVER (PARTITION BY key) > 0 THEN CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY key) AS DOUBLE) ELSE 0 END AS share FROM m"""
)
def merged_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as weights of features by number: the first two are one season, those after the fourth have no label."""
    items = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("feature"), (F.col("l_quantity") - 25).cast("double").alias("weight"))
    labels = spark.createDataFrame([(1, "Season"), (2, "Season"), (3, "Reviews"), (4, "Meetings")], "feature int, label string")
    return forecast.merged_drivers(items, labels).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT event_type, stddev_pop(CASE WHEN event_type = 'click' THEN 1 ELSE value END) > 1e-9 AS signal FROM events GROUP BY 1")
def signal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.when(F.col("event_type") == "click", 1.0).otherwise(F.col("value"))
    return tables.table(spark, sf_dir, "events").withColumn("value", flat).groupBy("event_type").agg(forecast.has_signal("value").alias("signal"))


@query(
    """SELECT event_id, coalesce(CAST(value AS FLOAT), 0) AS first, coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN user_id END AS FLOAT), 0) AS second, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code,
CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'cold' WHEN user_id % 2 = 0 THEN 'live' ELSE 'active' END AS state FROM events"""
)
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a matrix of two features, one with gaps, with a code for their type and a state of their forecast."""
    events = tables.table(spark, sf_dir, "events").withColumn("u", F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("double")).otherwise(float("nan")))
    state = forecast.forecast_state(F.col("event_id") % 5 == 0, F.col("event_id") % 3 == 0, F.col("user_id") % 2)
    row = events.select("event_id", forecast.matrix_row(["value", "u"]).alias("m"), forecast.covariate_code(F.col("event_type"), ["view", "click"]).alias("code"), state.alias("state"))
    return row.select("event_id", F.get("m", 0).alias("first"), F.get("m", 1).alias("second"), F.col("code").cast("int").alias("code"), "state")
