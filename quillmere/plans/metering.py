"""Queries on usage and credit ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators import ledger
from quillmere.plans.registry import query
from quillmere.sources import tables
from quillmere.sources.tables import CREDITS_SQL, USAGE_SQL

START, NOW, END = "1998-08-01", "1998-08-20", "1998-09-01"
FEATURES = ("AF", "AO", "NF", "NO", "RF", "RO")
TARGETS = ("burnout", "velocity", "bus_factor", "review_latency", "topic_shift", "decision_cadence")

_IN_USAGE = f"occurred_at >= TIMESTAMP '{START}' AND occurred_at < TIMESTAMP '{END}'"
_IN_CREDITS = f"created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'"
_BALANCE_SQL = f"""{USAGE_SQL}, {CREDITS_SQL},
g AS (SELECT tenant_id, sum(credits) AS granted FROM credits WHERE {_IN_CREDITS} GROUP BY 1),
s AS (SELECT tenant_id, sum(credits) AS spent FROM usage WHERE {_IN_USAGE} GROUP BY 1),
bal AS (SELECT tenant_id, coalesce(granted, 0) AS granted, coalesce(spent, 0) AS spent, coalesce(granted, 0) - coalesce(spent, 0) AS balance FROM g FULL JOIN s USING (tenant_id))"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.usage_ledger(spark, sf_dir), tables.credit_ledger(spark, sf_dir)


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.balances(*_both(spark, sf_dir), START, END)


@query(f"WITH {_BALANCE_SQL} SELECT tenant_id, CAST(granted AS DECIMAL(30,6)) AS granted, CAST(spent AS DECIMAL(30,6)) AS spent, CAST(balance AS DECIMAL(30,6)) AS balance FROM bal")
def balance_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir)


@query(f"WITH {_BALANCE_SQL} SELECT tenant_id, round(CAST(CASE WHEN tenant_id % 3 = 0 THEN floor(balance) ELSE balance END - balance AS DOUBLE), 6) AS drift FROM bal WHERE tenant_id % 3 = 0 AND abs(floor(balance) - balance) > 0.01")
def reconcile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds whole credits for every third tenant is held against the ledger."""
    found = _balances(spark, sf_dir)
    cached = found.select("tenant_id", F.when(F.col("tenant_id") % 3 == 0, F.floor("balance")).otherwise(F.col("balance")).alias("balance"))
    return ledger.reconcile(cached, found).select("tenant_id", F.round(F.col("drift").cast("double"), 6).alias("drift"))


_FEATURES_SQL = f"""{USAGE_SQL}, f AS (SELECT tenant_id, feature, sum(credits) AS credits, sum(quantity) AS quantity FROM usage WHERE {_IN_USAGE} AND credits > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY credits DESC, feature) AS rank FROM f)"""


@query(
    f"""WITH {_FEATURES_SQL}, t AS (SELECT * FROM r WHERE rank <= 4)
SELECT tenant_id, rank, feature, floor(CAST(credits AS DOUBLE) * 100 + 0.5) / 100 AS credits, CAST(quantity AS DOUBLE) AS quantity, round(CAST(credits AS DOUBLE) / sum(CAST(credits AS DOUBLE)) OVER (PARTITION BY tenant_id), 6) AS share FROM t"""
)
def usage_by_feature_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top four of six features, so that the share is of what is shown."""
    found = ledger.feature_breakdown(tables.usage_ledger(spark, sf_dir), START, END, 4)
    return found.select("tenant_id", "rank", "feature", ledger.half_up(F.col("credits")).alias("credits"), F.col("quantity").cast("double").alias("quantity"), F.round("share", 6).alias("share"))


@query(f"WITH {USAGE_SQL} SELECT tenant_id, CAST(occurred_at AS DATE) AS day, feature, CAST(sum(credits) AS DOUBLE) AS credits, count(*) AS uses FROM usage WHERE {_IN_USAGE} GROUP BY ALL")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily(tables.usage_ledger(spark, sf_dir), START, END).withColumn("credits", F.col("credits").cast("double"))


@query(
    f"""WITH {USAGE_SQL}, f AS (SELECT tenant_id, actor, feature, sum(credits) AS c FROM usage WHERE {_IN_USAGE} GROUP BY ALL),
top AS (SELECT tenant_id, actor, feature AS top_feature FROM f QUALIFY row_number() OVER (PARTITION BY tenant_id, actor ORDER BY c DESC, feature) = 1),
a AS (SELECT tenant_id, actor, sum(c) AS credits FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY credits DESC, actor) AS rank, sum(credits) OVER (PARTITION BY tenant_id) AS total, count(*) OVER (PARTITION BY tenant_id) AS actors FROM a)
SELECT tenant_id, rank, actor, CAST(credits AS DOUBLE) AS credits, top_feature, round(CAST(credits AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share, greatest(0, actors - 8) AS more
FROM r JOIN top USING (tenant_id, actor) WHERE rank <= 8"""
)
def usage_top_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.top_consumers(tables.usage_ledger(spark, sf_dir), START, END)
    return found.withColumn("credits", F.col("credits").cast("double")).withColumn("share", F.round("share", 6)).withColumn("more", F.col("more").cast("long"))


@query(
    f"""WITH {_BALANCE_SQL}, u AS (SELECT tenant_id, CAST(sum(CASE WHEN occurred_at >= TIMESTAMP '{START}' THEN credits ELSE 0 END) AS DOUBLE) AS used,
  CAST(sum(CASE WHEN occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN credits ELSE 0 END) AS DOUBLE) / 7 AS mean_7d
  FROM usage WHERE occurred_at < TIMESTAMP '{NOW}' AND (occurred_at >= TIMESTAMP '{START}' OR occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) GROUP BY 1),
p AS (SELECT u.tenant_id, used, mean_7d, CAST(granted AS DOUBLE) / 10 AS included, used + mean_7d * 12.0 AS projected FROM u JOIN bal ON u.tenant_id = bal.tenant_id)
SELECT tenant_id, round(used, 6) AS used, round(mean_7d, 6) AS mean_7d, round(projected, 6) AS projected,
  CASE WHEN included <= 0 THEN 'on_track' WHEN projected > included THEN 'over' WHEN projected > included * 0.9 THEN 'near' ELSE 'on_track' END AS state FROM p"""
)
def usage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    included = _balances(spark, sf_dir).select("tenant_id", (F.col("granted").cast("double") / 10).alias("included"))
    found = ledger.projection(tables.usage_ledger(spark, sf_dir), included, START, NOW, END)
    return found.select("tenant_id", F.round("used", 6).alias("used"), F.round("mean_7d", 6).alias("mean_7d"), F.round("projected", 6).alias("projected"), "state")


@query(
    f"""WITH {_BALANCE_SQL}, u AS (SELECT tenant_id, CAST(sum(CASE WHEN occurred_at >= TIMESTAMP '{START}' THEN credits ELSE 0 END) AS DOUBLE) AS used,
  CAST(sum(CASE WHEN occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN credits ELSE 0 END) AS DOUBLE) / 7 AS mean_7d
  FROM usage WHERE occurred_at < TIMESTAMP '{NOW}' AND (occurred_at >= TIMESTAMP '{START}' OR occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) GROUP BY 1),
p AS (SELECT u.tenant_id, used, mean_7d, CAST(granted AS DOUBLE) / 10 * (u.tenant_id % 4) AS included, used + mean_7d * 12.0 AS projected FROM u JOIN bal ON u.tenant_id = bal.tenant_id),
st AS (SELECT *, CASE WHEN included <= 0 THEN 'on_track' WHEN projected > included THEN 'over' WHEN projected > included * 0.9 THEN 'near' ELSE 'on_track' END AS state FROM p)
SELECT tenant_id, state, CASE WHEN included <= 0 THEN 'Nothing metered this period. Chat, search, and forecasts are included and never use credits.'
  WHEN state = 'over' THEN 'Projected to exceed by about ' || regexp_replace(printf('%.2f', floor((projected - included) * 100 + 0.5) / 100), '\\.?0+$', '') || ' credits.'
  WHEN state = 'near' THEN 'Close — projected to use about ' || CAST(floor(projected / included * 100 + 0.5) AS BIGINT) || '% of your allowance.'
  ELSE 'On track — about ' || regexp_replace(printf('%.2f', floor((included - projected) * 100 + 0.5) / 100), '\\.?0+$', '') || ' credits to spare.' END AS sentence,
  CASE WHEN state = 'over' AND mean_7d > 0 THEN CASE WHEN included <= used THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{NOW}' + to_seconds(floor((included - used) / mean_7d * 86400)) END END AS exhausted_at FROM st"""
)
def usage_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the projection means in words, and when allowances that will be exceeded are used up; a quarter of the tenants have none."""
    included = _balances(spark, sf_dir).select("tenant_id", (F.col("granted").cast("double") / 10 * (F.col("tenant_id") % 4)).alias("included"))
    found = ledger.projected_words(ledger.projection(tables.usage_ledger(spark, sf_dir), included, START, NOW, END), NOW)
    return found.select("tenant_id", "state", "sentence", "exhausted_at")


_CURSOR = ("1999-01-01", "5")


@query(
    f"""WITH {USAGE_SQL} SELECT occurred_at, idempotency_key, feature, CAST(credits AS DOUBLE) AS credits FROM usage
WHERE tenant_id = 7 AND (occurred_at < TIMESTAMP '{_CURSOR[0]}' OR (occurred_at = TIMESTAMP '{_CURSOR[0]}' AND idempotency_key < '{_CURSOR[1]}')) ORDER BY occurred_at DESC, idempotency_key DESC LIMIT 51"""
)
def receipts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.receipts(tables.usage_ledger(spark, sf_dir), 7, _CURSOR, 50)
    return found.select("occurred_at", "idempotency_key", "feature", F.col("credits").cast("double").alias("credits"))


_QUOTA_SQL = f"""{_BALANCE_SQL}, fs AS (SELECT tenant_id, feature, sum(credits) AS feature_spent FROM usage WHERE {_IN_USAGE} GROUP BY ALL),
q AS (SELECT bal.*, fs.feature, fs.feature_spent, 40 AS estimate, CASE WHEN feature IN ('AF', 'RO') THEN 300 END AS feature_cap, CASE WHEN bal.tenant_id % 4 = 0 THEN 500 END AS hard_cap, bal.tenant_id % 2 = 0 AS overage
      FROM bal JOIN fs ON bal.tenant_id = fs.tenant_id)"""


def _quota_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage, _ = _both(spark, sf_dir)
    by_feature = ledger.within(usage, "occurred_at", START, END).groupBy("tenant_id", "feature").agg(F.sum("credits").alias("feature_spent"))
    return (
        _balances(spark, sf_dir).join(by_feature, "tenant_id").withColumn("estimate", F.lit(40)).withColumn("feature_cap", F.when(F.col("feature").isin("AF", "RO"), 300))
        .withColumn("hard_cap", F.when(F.col("tenant_id") % 4 == 0, 500)).withColumn("overage", F.col("tenant_id") % 2 == 0)
    )


@query(
    f"""WITH {_QUOTA_SQL}, d AS (SELECT *, CASE WHEN feature_spent + estimate > feature_cap THEN 'feature_cap' WHEN spent >= hard_cap THEN 'hard_cap' WHEN NOT overage AND balance < estimate THEN 'no_credits' ELSE 'ok' END AS decision FROM q)
SELECT tenant_id, feature, decision, decision = 'ok' AND balance - estimate < 0 AS will_go_negative FROM d"""
)
def quota_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quota(_quota_rows(spark, sf_dir)).select("tenant_id", "feature", "decision", "will_go_negative")


@query(
    f"""WITH {_QUOTA_SQL}, d AS (SELECT *, CASE WHEN feature_spent >= feature_cap THEN 'feature_cap' WHEN spent >= hard_cap THEN 'hard_cap' WHEN NOT overage AND balance <= 0 THEN 'no_credits' END AS reason FROM q)
SELECT tenant_id, feature, reason FROM d WHERE reason IS NOT NULL"""
)
def paused_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are paused already; here a cap that is just reached counts."""
    reason = (
        F.when(F.col("feature_spent") >= F.col("feature_cap"), "feature_cap").when(F.col("spent") >= F.col("hard_cap"), "hard_cap")
        .when(~F.col("overage") & (F.col("balance") <= 0), "no_credits")
    )
    return _quota_rows(spark, sf_dir).select("tenant_id", "feature", reason.alias("reason")).where("reason IS NOT NULL")


@query(
    f"""WITH {_BALANCE_SQL}, t AS (SELECT tenant_id, CAST(floor(100 * CAST(spent AS DOUBLE) / (CAST(granted AS DOUBLE) / 30)) AS BIGINT) AS percent, unnest([50, 75, 90, 100]) AS threshold FROM bal WHERE granted > 0)
SELECT tenant_id, threshold, percent FROM t WHERE percent >= threshold AND NOT (tenant_id = 3 AND threshold = 50)"""
)
def alerts_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = _balances(spark, sf_dir).select("tenant_id", "spent", (F.col("granted").cast("double") / 30).alias("included"))
    fired = spark.range(1).select(F.lit(3).cast("long").alias("tenant_id"), F.lit(50).alias("threshold"))
    return ledger.alerts(spent, [50, 75, 90], fired)


_MARGIN_SQL = f"""{USAGE_SQL}, {CREDITS_SQL}, f AS (SELECT tenant_id, CAST(date_trunc('week', occurred_at) AS DATE) AS week, feature, sum(cost_micros) AS c FROM usage GROUP BY ALL),
w AS (SELECT tenant_id, week, CAST(sum(c) AS BIGINT) AS cost_micros, max_by(feature, struct_pack(c := c, f := feature)) AS top_feature FROM f GROUP BY ALL),
b AS (SELECT tenant_id, CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS purchases FROM credits WHERE kind = 'purchase' GROUP BY ALL),
m AS (SELECT w.*, 1000000.0 / 4 + coalesce(purchases, 0) * 10000.0 AS revenue FROM w LEFT JOIN b USING (tenant_id, week)),
n AS (SELECT *, (revenue - cost_micros) / revenue AS margin FROM m)"""


@query(
    f"""WITH {_MARGIN_SQL} SELECT tenant_id, week, cost_micros, top_feature, revenue, round(margin, 6) AS margin,
margin < 0.4 AND coalesce(lag(margin) OVER o < 0.4 AND lag(week) OVER o = week - 7, false) AS flagged FROM n WINDOW o AS (PARTITION BY tenant_id ORDER BY week)"""
)
def margin_two_week_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.margins(*_both(spark, sf_dir), 1_000_000.0, 10_000.0).withColumn("margin", F.round("margin", 6))


@query(
    f"""WITH {_MARGIN_SQL}, r AS (SELECT tenant_id, week, round(margin, 6) AS margin, dense_rank() OVER (ORDER BY week DESC) AS recent FROM n)
SELECT week, tenant_id, margin FROM r WHERE recent <= 4"""
)
def margin_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four weeks of all tenants. The weeks are found first, so that no window gathers all rows."""
    found = ledger.margins(*_both(spark, sf_dir), 1_000_000.0, 10_000.0)
    weeks = found.select("week").distinct().orderBy(F.desc("week")).limit(4)
    return found.join(F.broadcast(weeks), "week").select("week", "tenant_id", F.round("margin", 6).alias("margin")).orderBy(F.desc("week"), F.asc_nulls_last("margin"))


@query(
    f"""WITH {CREDITS_SQL}, t AS (SELECT DISTINCT tenant_id FROM credits), m AS (SELECT unnest(['1998-06', '1998-07', '1998-08']) AS period)
SELECT tenant_id, period, 'allowance:' || tenant_id || ':' || period AS idempotency_key, 1000 + 100 * (tenant_id % 3) AS credits FROM t, m WHERE NOT (period = '1998-06' AND tenant_id < 10)"""
)
def allowance_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grant for each tenant and month; the first ten tenants have June's already."""
    tenants = tables.credit_ledger(spark, sf_dir).select("tenant_id").distinct()
    keyed = tenants.withColumn("period", F.explode(F.array(*map(F.lit, ("1998-06", "1998-07", "1998-08")))))
    keyed = keyed.withColumn("idempotency_key", F.concat_ws(":", F.lit("allowance"), "tenant_id", "period")).withColumn("credits", 1000 + 100 * (F.col("tenant_id") % 3))
    there = spark.range(10).select(F.concat_ws(":", F.lit("allowance"), "id", F.lit("1998-06")).alias("idempotency_key"))
    return keyed.join(there, "idempotency_key", "left_anti").select("tenant_id", "period", "idempotency_key", "credits")


@query(f"WITH {_BALANCE_SQL} SELECT tenant_id, 'expiry:' || tenant_id || ':1998-08' AS idempotency_key, CAST(-greatest(0, granted - spent) AS DOUBLE) AS credits FROM bal WHERE granted > spent")
def expiry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a month leaves expires in that month's own period, so that it doesn't lessen the next allowance."""
    left = F.greatest(F.lit(0).cast(ledger.MONEY), F.col("granted") - F.col("spent"))
    found = _balances(spark, sf_dir).where("granted > spent")
    return found.select("tenant_id", F.concat_ws(":", F.lit("expiry"), "tenant_id", F.lit("1998-08")).alias("idempotency_key"), (-left).cast("double").alias("credits"))


@query(
    f"""WITH {USAGE_SQL}, d AS (SELECT tenant_id, CAST(occurred_at AS DATE) AS day, CAST(sum(quantity) AS DOUBLE) AS batch FROM usage WHERE {_IN_USAGE} GROUP BY ALL),
r AS (SELECT *, sum(batch) OVER (PARTITION BY tenant_id ORDER BY day) - batch AS before FROM d)
SELECT tenant_id, day, batch, greatest(0, batch - greatest(0, 2000 - before)) AS billable FROM r"""
)
def ingest_billable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's batch has beyond what is left of the month's allowance."""
    days = ledger.within(tables.usage_ledger(spark, sf_dir), "occurred_at", START, END).groupBy("tenant_id", F.to_date("occurred_at").alias("day")).agg(F.sum("quantity").cast("double").alias("batch"))
    before = F.sum("batch").over(Window.partitionBy("tenant_id").orderBy("day")) - F.col("batch")
    return days.withColumn("before", before).select("tenant_id", "day", "batch", F.greatest(F.lit(0.0), F.col("batch") - F.greatest(F.lit(0.0), 2000 - F.col("before"))).alias("billable"))


@query(f"WITH {USAGE_SQL} SELECT feature, count(*) AS n, CAST(sum(credits) AS DOUBLE) AS credits FROM usage WHERE NOT starts_with(idempotency_key, '1') GROUP BY feature")
def meter_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger sent twice, with unusable rows among it, to a ledger that has the keys that begin with 1."""
    usage = tables.usage_ledger(spark, sf_dir)
    nameless = usage.where("actor = 1").withColumn("idempotency_key", F.lit(None).cast("string"))
    negative = usage.where("actor = 2").withColumn("quantity", F.lit(-1).cast("decimal(20,6)")).withColumn("idempotency_key", F.concat(F.lit("x"), "idempotency_key"))
    broken = nameless.unionByName(negative)
    found = ledger.idempotent(usage.unionByName(usage).unionByName(broken), usage.where(F.col("idempotency_key").startswith("1")))
    return found.groupBy("feature").agg(F.count("*").alias("n"), F.sum("credits").cast("double").alias("credits"))


@query(
    """WITH b(feature, rate, cost) AS (VALUES ('meeting_agent', 1.0, 9000), ('voice_synthesis', 0.5, 2400), ('bulk_ingest', 10.0, 40000), ('forecast_target', 50.0, 120000), ('model_retrain', 200.0, 800000), ('api_request', 2.0, 6000)),
i AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'meeting_agent' WHEN 1 THEN 'voice_synthesis' WHEN 2 THEN 'bulk_ingest' WHEN 3 THEN 'forecast_target' WHEN 4 THEN 'model_retrain' ELSE 'api_request' END AS feature, l_quantity FROM lineitem)
SELECT feature, count(*) AS n, round(sum(l_quantity * rate), 4) AS credits, CAST(sum(CAST(floor(l_quantity * 1000000 + 0.5) AS BIGINT) * cost // 1000000) AS BIGINT) AS cost_micros FROM i JOIN b USING (feature) GROUP BY feature"""
)
def price_book_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits and real cost of uses by the price book; the cost is cut off after scaling."""
    names = [row[0] for row in ledger.PRICE_BOOK]
    book = spark.createDataFrame([(n, rate, cost) for n, _, rate, cost, *_ in ledger.PRICE_BOOK], "feature string, rate double, cost long")
    feature = F.element_at(F.array(*map(F.lit, names)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    uses = tables.table(spark, sf_dir, "lineitem").select(feature.alias("feature"), "l_quantity")
    cost = F.expr("cast(floor(l_quantity * 1000000 + 0.5) AS BIGINT) * cost div 1000000")
    return uses.join(F.broadcast(book), "feature").groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("rate")), 4).alias("credits"), F.sum(cost).alias("cost_micros"))


@query(f"WITH {CREDITS_SQL}, t AS (SELECT DISTINCT tenant_id FROM credits) SELECT tenant_id, target, 'forecast:' || tenant_id || ':' || target || ':1998-08' AS idempotency_key, 50.0 AS credits FROM t, (SELECT unnest({list(TARGETS)}) AS target)")
def forecast_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = tables.credit_ledger(spark, sf_dir).select("tenant_id").distinct().withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    return tenants.select("tenant_id", "target", F.concat_ws(":", F.lit("forecast"), "tenant_id", "target", F.lit("1998-08")).alias("idempotency_key"), F.lit(50.0).alias("credits"))


_USES = ("meeting_agent", "voice_synthesis", "bulk_ingest", "forecast_target", "model_retrain", "api_request", "unknown")


@query(
    f"""WITH u AS (SELECT o_custkey % 20 AS tenant_id, {list(_USES)}[o_orderkey % 7 + 1] AS feature, o_orderkey % 500 AS counted, 'use:' || o_orderkey AS idempotency_key FROM orders),
p AS (FROM (VALUES ('meeting_agent', 'minute', 1.0, 9000, 1), ('voice_synthesis', 'kchar', 0.5, 2400, 1000), ('bulk_ingest', 'kdoc', 10.0, 40000, 1000), ('forecast_target', 'month', 50.0, 120000, 1), ('model_retrain', 'run', 200.0, 800000, 1), ('api_request', 'krequest', 2.0, 6000, 1000)) AS v(feature, unit, credits, cost, size))
SELECT tenant_id, u.feature, unit, counted / size AS quantity, CAST(counted / size * p.credits AS DOUBLE) AS credits, CAST(CAST(floor(counted / size * 1000000 + 0.5) AS BIGINT) * cost // 1000000 AS BIGINT) AS cost_micros, idempotency_key FROM u JOIN p USING (feature) WHERE counted > 0"""
)
def metered_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uses of six features, each in its own unit, and of one that isn't known."""
    key = F.col("o_orderkey")
    feature = F.element_at(F.array(*map(F.lit, _USES)), (key % 7 + 1).cast("int"))
    return ledger.metered(tables.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("tenant_id"), feature.alias("feature"), (key % 500).alias("counted"), F.concat(F.lit("use:"), key).alias("idempotency_key")))


@query(
    """WITH c AS (SELECT conv_id % 20 AS tenant_id, conv_id || ':' || turn AS request_id, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'chat' END AS surface, length(text) AS n FROM conversations),
m AS (SELECT tenant_id, CASE WHEN surface = 'search' THEN 'search' ELSE 'chat' END AS feature, 1.0::DOUBLE AS quantity, 'run' AS unit, 0.0::DOUBLE AS credits, n * 3 AS cost_micros,
  '{"input_tokens":"' || n // 4 || '","model":"m' || tenant_id % 2 || '"' || CASE WHEN surface IS NULL THEN '' ELSE ',"surface":"' || surface || '"' END || ',"unmetered":"true"}' AS metadata, 'llm:' || request_id AS idempotency_key FROM c)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY tenant_id, feature, cost_micros, metadata) = 1"""
)
def model_calls_unmetered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as calls of a model, each reported twice: the customer is charged nothing, and the cost reaches the ledger."""
    turns = tables.table(spark, sf_dir, "conversations")
    tenant, size = F.col("conv_id") % 20, F.length("text")
    calls = turns.select(
        tenant.alias("tenant_id"), F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "chat").alias("surface"),
        F.concat(F.lit("m"), tenant % 2).alias("model"), F.expr("length(text) div 4").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), (size * 3).cast("long").alias("cost_micros"),
    )
    return ledger.model_calls(calls.unionByName(calls))


@query(
    """WITH r AS (SELECT l_suppkey % 20 AS tenant_id, l_orderkey, max(l_quantity - 10) AS credits FROM lineitem GROUP BY ALL)
SELECT tenant_id, 'voice_synthesis' AS feature, -CAST(credits AS DOUBLE) AS credits, 'correction:' || l_orderkey AS idempotency_key FROM r WHERE credits > 0"""
)
def credit_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as requests to give credits back for an order, several for one, some of nothing."""
    items = tables.table(spark, sf_dir, "lineitem")
    asked = items.select((F.col("l_suppkey") % 20).alias("tenant_id"), F.lit("voice_synthesis").alias("feature"), F.col("l_orderkey").alias("event_id"), (F.col("l_quantity") - 10).cast("double").alias("credits"))
    return ledger.corrections(asked).select("tenant_id", "feature", "credits", "idempotency_key")


@query("SELECT o_custkey % 20 AS tenant_id, 'purchase' AS kind, CAST(o_totalprice AS DOUBLE) AS credits, o_orderkey AS idempotency_key FROM orders WHERE o_orderkey % 9 > 1")
def purchases_fulfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments that are delivered twice; some of nothing, some of no number."""
    key = F.col("o_orderkey")
    credits = F.when(key % 9 == 0, 0.0).when(key % 9 == 1, float("nan")).otherwise(F.col("o_totalprice").cast("double"))
    once = tables.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("tenant_id"), key.alias("event_id"), credits.alias("credits"))
    return ledger.purchases(once.unionByName(once))


@query(
    """WITH b AS (SELECT o_custkey % 20 AS tenant_id, o_orderkey AS batch_id, o_orderdate AS made, o_orderkey % 700 AS documents FROM orders WHERE o_orderkey % 700 > 0),
r AS (SELECT *, coalesce(sum(documents) OVER (PARTITION BY tenant_id ORDER BY made, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
e AS (SELECT *, greatest(0, documents - greatest(0, 5000 - before)) AS excess FROM r)
SELECT tenant_id, 'connector_sync' AS feature, documents / 1000 AS quantity, 0.0::DOUBLE AS credits, CAST(CAST(floor(documents / 1000 * 1000000 + 0.5) AS BIGINT) * 40000 // 1000000 AS BIGINT) AS cost_micros, 'ingest-volume:' || batch_id AS idempotency_key, 'kdoc' AS unit FROM e
UNION ALL SELECT tenant_id, 'bulk_ingest', excess / 1000, excess / 1000 * 10, CAST(CAST(floor(excess / 1000 * 1000000 + 0.5) AS BIGINT) * 40000 // 1000000 AS BIGINT), 'ingest:' || batch_id, 'kdoc' FROM e WHERE excess > 0"""
)
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of documents, of which a tenant has 5,000 free."""
    orders = tables.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("tenant_id"), F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 700).alias("documents"))
    return ledger.ingest_batches(orders, F.lit(5000))
