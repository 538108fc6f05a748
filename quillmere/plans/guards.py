"""Queries on what is guarded: row policies, append-only ledgers, keys, and versions with their gate."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import keys, versions
from quillmere.plans.registry import query
from quillmere.sources import appendonly, policies, staging, tables


@query(
    """WITH s AS (SELECT unnest(['3', '7', 'none']) AS session)
SELECT session, count(c_custkey) AS n, coalesce(round(sum(c_acctbal), 2), 0) AS balance, count(CASE WHEN CAST(c_nationkey AS VARCHAR) <> session THEN 1 END) AS foreign_rows
FROM s LEFT JOIN customer ON CAST(c_nationkey AS VARCHAR) = session GROUP BY session"""
)
def tenant_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view of all customers, as two tenants see it and as a session without one does."""
    policies.guard(spark, tables.table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "tenant_id"), "guarded_customers")
    found = []
    for tenant in ("3", "7", None):
        policies.enter(spark, tenant)
        rows = spark.table("guarded_customers")
        found.append(staging.written(rows.agg(
            F.lit(tenant or "none").alias("session"), F.count("*").alias("n"), F.coalesce(F.round(F.sum("c_acctbal"), 2), F.lit(0.0)).alias("balance"),
            F.count_if(F.col("tenant_id").cast("string") != F.lit(tenant or "none")).alias("foreign_rows"),
        ), "tenant-view"))
    policies.enter(spark, None)
    return reduce(DataFrame.unionByName, found)


@query("SELECT CAST(o_orderkey % 3 AS INT) AS version, count(*) AS n, round(sum(o_totalprice), 2) AS total, 3 AS verified FROM orders GROUP BY 1")
def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a ledger in three versions, which are then verified row by row and read."""
    ledger = appendonly.Ledger(spark, f"{staging.folder(spark)}/ledger-{uuid.uuid4().hex}")
    orders = tables.table(spark, sf_dir, "orders")
    for k in range(3):
        ledger.append(orders.where(F.col("o_orderkey") % 3 == k))
    verified = ledger.verify()
    return ledger.read().groupBy("version").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("verified", F.lit(verified))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 > 0 THEN c_name END AS name, true AS hidden FROM customer")
def keys_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sealed under tenants' random keys; the master key is changed, and each fifth tenant's key destroyed: its names stay closed, the others open."""
    old, new = os.urandom(keys.BYTES), os.urandom(keys.BYTES)
    customers = tables.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant_id"), F.col("c_name").alias("name"))
    own = keys.issued(customers, old)
    closed = staging.written(keys.seal(customers.withColumn("plain", F.col("name")), "name", own, old), "sealed")
    left = keys.shredded(keys.rotated(own, old, new), customers.where("tenant_id % 5 = 0").select("tenant_id").distinct())
    hidden = closed.select("c_custkey", (~F.contains("name", F.encode("plain", "UTF-8"))).alias("hidden"))
    return keys.unseal(closed.drop("plain"), "name", left, new).select("c_custkey", "name").join(hidden, "c_custkey")


_STATS = """d AS (SELECT user_id % 5 AS tenant_id, CAST(ts AS DATE) AS seen, count(*) // 15 AS level FROM events WHERE day(ts) % 2 = 0 GROUP BY ALL),
v AS (SELECT *, lag(level) OVER (PARTITION BY tenant_id ORDER BY seen) AS before FROM d),
k AS (SELECT tenant_id, seen AS valid_from, level, row_number() OVER (PARTITION BY tenant_id ORDER BY seen) AS version FROM v WHERE before IS DISTINCT FROM level)"""


@query(f"WITH {_STATS}, e AS (SELECT event_id, user_id % 5 AS tenant_id, ts FROM events) SELECT event_id, version, level, valid_from FROM e ASOF LEFT JOIN k ON e.tenant_id = k.tenant_id AND e.ts >= k.valid_from")
def statistics_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the version of its tenant's statistics that was valid then; observations that say the same as before make no version."""
    events = tables.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("tenant_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    seen = events.where(F.day("ts") % 2 == 0).groupBy("tenant_id", F.to_date("ts").alias("seen")).agg(F.expr("count(*) div 15").alias("level"))
    known = versions.changed(seen, ["tenant_id"], "seen", ["level"]).select("tenant_id", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("version").cast("long").alias("version"), "level")
    return versions.as_of(events, known, ["tenant_id"], "ts", "valid_from").select("event_id", "version", "level", F.to_date("valid_from").alias("valid_from"))


@query(
    """WITH l AS (SELECT l_returnflag || l_linestatus || '-' || l_suppkey % 4 AS model, l_suppkey % 10 AS tenant_id, l_discount AS champion, CASE WHEN l_orderkey % 11 > 0 THEN l_tax * (0.8 + 0.2 * (l_suppkey % 4)) END AS challenger FROM lineitem),
p AS (SELECT *, champion - challenger AS g FROM l WHERE challenger IS NOT NULL),
t AS (SELECT model, tenant_id, CASE WHEN avg(champion) > 0 THEN avg(challenger) / avg(champion) - 1 WHEN avg(challenger) > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS change FROM p GROUP BY ALL),
w AS (SELECT model, count(*) AS pairs, avg(g) AS gain, coalesce(stddev_samp(g), 0) / sqrt(count(*)) AS error FROM p GROUP BY model),
m AS (SELECT model, max(change) AS worst FROM t GROUP BY model),
r AS (SELECT model, CASE WHEN coalesce(pairs, 0) < 8 THEN 'too few pairs' WHEN gain - 2 * error <= 0 THEN 'no sure gain' WHEN worst > 0.05 THEN 'worse for a tenant' ELSE 'better' END AS reason, coalesce(pairs, 0) AS pairs, gain, worst
      FROM (SELECT DISTINCT model FROM l) LEFT JOIN w USING (model) LEFT JOIN m USING (model))
SELECT model, reason = 'better' AS promote, reason, pairs, round(gain, 6) AS gain, round(worst, 6) AS worst_change FROM r"""
)
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases on which a challenger's loss is held against the champion's, some of which weren't measured."""
    supplier = F.col("l_suppkey")
    losses = tables.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus", F.lit("-"), supplier % 4).alias("model"), (supplier % 10).alias("tenant_id"), F.col("l_discount").alias("champion"),
        F.when(F.col("l_orderkey") % 11 > 0, F.col("l_tax") * (0.8 + 0.2 * (supplier % 4))).alias("challenger"),
    )
    return versions.gate(losses).select("model", "promote", "reason", "pairs", F.round("gain", 6).alias("gain"), F.round("worst_change", 6).alias("worst_change"))
