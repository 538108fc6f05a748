"""Frames in the shapes that operators take, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"view": "doc_edited", "click": "message", "signup": "task_assigned", "purchase": "task_completed", "error": "task_reopened"}

#: Openings that the turns of conversations are given, as their own words name no source, event or intent.
OPENINGS = (
    "What tasks were assigned in notion last week?", "From now on, add meeting notes to the brain until June.", "Add a note that we decided to ship.", "Where is the retry handler implemented in the repo?",
    "Who are the devs in the company?", "Update the page: what did we agree on pull requests?", "Summarise for me the e-mails about coding best practises.", "The Q3 forecast shows a spike.",
    "Log the standup call.", "", "Which file has the schema of the knowledge base?", "Write a weekly digest of all documents and google docs every morning.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, ts, actor, kind, review_delay_s: activity of five tenants."""
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("tenant_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("string").alias("actor"), kind.alias("kind"),
        F.get_json_object("props", "$.k").cast("double").alias("review_delay_s"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, prose: every turn of every conversation, whole, after one of OPENINGS."""
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(opening, F.lit(" "), "text").alias("prose"))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, actor, feature, quantity, credits, cost_micros, occurred_at, idempotency_key: a line item is a use."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("tenant_id"))
    items = table(spark, sf_dir, "lineitem")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        "tenant_id", F.col("l_suppkey").alias("actor"), F.concat("l_returnflag", "l_linestatus").alias("feature"), F.col("l_quantity").cast("decimal(20,6)").alias("quantity"),
        (F.col("l_quantity") * 0.5).cast("decimal(20,6)").alias("credits"), F.floor("l_extendedprice").cast("long").alias("cost_micros"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("occurred_at"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("idempotency_key"),
    )


def credit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, kind, credits, created_at, idempotency_key: an order grants credits."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "purchase").when(F.col("o_orderpriority") == "5-LOW", "adjustment").otherwise("allowance")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("tenant_id"), kind.alias("kind"), (F.col("o_totalprice") / 100).cast("decimal(20,6)").alias("credits"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), F.col("o_orderkey").alias("idempotency_key"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: a binary forest over the parts with one edge back, so that there is a cycle."""
    tree = table(spark, sf_dir, "part").select(F.expr("p_partkey div 2").alias("source"), F.col("p_partkey").alias("target")).where("source > 0")
    return tree.unionByName(spark.range(1).select(F.lit(40).cast("long").alias("source"), F.lit(5).cast("long").alias("target")))


#: The same frames for the SQL that queries are checked against.
EVENTS_SQL = """ev AS (
  SELECT user_id % 5 AS tenant_id, ts, CAST(user_id AS VARCHAR) AS actor,
         CASE event_type WHEN 'view' THEN 'doc_edited' WHEN 'click' THEN 'message' WHEN 'signup' THEN 'task_assigned' WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_reopened' END AS kind,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS review_delay_s
  FROM events
)"""
USAGE_SQL = """usage AS (
  SELECT o_custkey % 20 AS tenant_id, l_suppkey AS actor, l_returnflag || l_linestatus AS feature, CAST(l_quantity AS DECIMAL(20,6)) AS quantity,
         CAST(l_quantity * 0.5 AS DECIMAL(20,6)) AS credits, CAST(floor(l_extendedprice) AS BIGINT) AS cost_micros, l_shipdate AS occurred_at,
         concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS idempotency_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
CREDITS_SQL = """credits AS (
  SELECT o_custkey % 20 AS tenant_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'purchase' WHEN '5-LOW' THEN 'adjustment' ELSE 'allowance' END AS kind,
         CAST(o_totalprice / 100 AS DECIMAL(20,6)) AS credits, o_orderdate AS created_at, o_orderkey AS idempotency_key
  FROM orders
)"""
EDGES_SQL = """edges AS (
  SELECT p_partkey // 2 AS source, p_partkey AS target FROM part WHERE p_partkey // 2 > 0
  UNION ALL SELECT 40, 5
)"""
_OPENINGS_SQL = ", ".join(f"'{o}'" for o in OPENINGS)
PROMPTS_SQL = f"prompts AS (SELECT conv_id, turn, role, [{_OPENINGS_SQL}][(conv_id + turn) % {len(OPENINGS)} + 1] || ' ' || text AS prose FROM conversations)"
