"""Queries on drafts, standing rules, labels, weekly texts and claims of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import labels, strings
from quillmere.operators import drafts, ingestion, retrieval, series
from quillmere.plans.registry import query
from quillmere.sources import tables

_TITLE_SQL = tables.PROMPTS_SQL + r""", t AS (SELECT *, prose AS text, trim(regexp_replace(prose, '\s+', ' ', 'g'), ' ') AS s FROM prompts),
n AS (SELECT *, CASE WHEN length(s) <= 60 THEN s WHEN 61 - instr(reverse(left(s, 60)), ' ') > 36 THEN left(s, CAST(60 - instr(reverse(left(s, 60)), ' ') AS BIGINT)) || '…' ELSE left(s, 60) || '…' END AS title FROM t)"""
_TYPE_SQL = f"CASE {' '.join(f'''WHEN regexp_matches(lower(text), '{p}') THEN '{n}' ''' for n, p in retrieval.BLOCK_TYPES)} ELSE 'note' END"
_EVENTS_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{e}' END" for e, p in drafts.EVENT_SIGNALS.items())
_RULES_SQL = f"""{_TITLE_SQL}, e AS (SELECT *, list_filter([{_EVENTS_SQL}], lambda x: x IS NOT NULL) AS found FROM n),
rules AS (SELECT conv_id, turn, CASE WHEN coalesce(title, '') = '' THEN 'Standing rule' ELSE title END AS name, CASE WHEN len(found) > 0 THEN found ELSE ['document_processed'] END AS triggers,
CASE WHEN regexp_matches(lower(text), '\\buntil\\b') THEN 'until_date' ELSE 'permanent' END AS persistence FROM e)"""


@query(
    f"""WITH {_TITLE_SQL}, d AS (SELECT conv_id, turn, text, title, CASE WHEN turn % 5 = 4 THEN 'todo' ELSE {_TYPE_SQL} END AS type, (length(text) % 130) / 100 AS confidence, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS author FROM n),
v AS (SELECT *, CASE WHEN type = 'todo' THEN 'type' WHEN trim(coalesce(title, ''), ' ') = '' THEN 'title' WHEN trim(coalesce(text, ''), ' ') = '' THEN 'body' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' WHEN NOT coalesce(author IN ('ai', 'human'), false) THEN 'author' END AS error FROM d)
SELECT conv_id, turn, type, error, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN author = 'human' OR confidence >= 0.7 THEN 'active' ELSE 'queued_for_review' END AS status FROM v"""
)
def draft_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a draft; its length makes up the confidence, and every fifth has a type that isn't known."""
    text, turn, role = F.col("prose"), F.col("turn"), F.col("role")
    author = F.when(role == "user", "human").when(role == "assistant", "ai").otherwise(role)
    found = tables.prompts(spark, sf_dir).select(
        "conv_id", "turn", "prose", strings.truncate_words(strings.squeezed(text), 60).alias("title"), F.when(turn % 5 == 4, "todo").otherwise(retrieval.block_type(text)).alias("type"),
        (F.length(text) % 130 / 100).alias("confidence"), author.alias("author"),
    )
    error = drafts.draft_error(F.col("type"), F.col("title"), text, F.col("confidence"), F.col("author"))
    status = F.when(F.col("error").isNotNull(), "rejected").otherwise(drafts.gate(F.col("confidence"), F.col("author")))
    return found.withColumn("error", error).select("conv_id", "turn", "type", "error", status.alias("status"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.prompts(spark, sf_dir).select("conv_id", "turn", drafts.standing_rule(F.col("prose")).alias("r")).select("conv_id", "turn", "r.*")


@query(f"WITH {_RULES_SQL} SELECT conv_id, turn, name, array_to_string(triggers, ',') AS triggers, persistence FROM rules")
def standing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).withColumn("triggers", F.array_join("triggers", ","))


_KINDS = {"view": "document_processed", "click": "meeting_attended", "purchase": "tft_forecast_completed", "signup": "daily_digest_due"}


@query(
    f"""WITH {_RULES_SQL}, r AS (SELECT conv_id % 5 AS tenant_id, unnest(triggers) AS event FROM rules WHERE turn % 3 <> 2),
ev2 AS (SELECT user_id % 5 AS tenant_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS event, count(*) AS events FROM events GROUP BY ALL)
SELECT tenant_id, event, count(*) AS rules, CAST(sum(events) AS BIGINT) AS firings FROM r JOIN ev2 USING (tenant_id, event) GROUP BY ALL"""
)
def rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a tenant's events set its rules off; two of three rules are enabled. Events are counted before they meet the rules."""
    rules = _rules(spark, sf_dir).select((F.col("conv_id") % 5).alias("tenant_id"), "triggers", (F.col("turn") % 3 != 2).alias("enabled"))
    event = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _KINDS.items()))
    events = tables.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("tenant_id"), event.alias("event")).agg(F.count("*").alias("events"))
    return drafts.fired(rules, events).groupBy("tenant_id", "event").agg(F.count("*").alias("rules"), F.sum("events").alias("firings"))


@query(
    """WITH u AS (SELECT l_orderkey, l_linenumber, ['minute', 'kchar', 'run', 'month'][l_linenumber % 4 + 1] AS unit, CAST(l_quantity AS DOUBLE) AS q, round(CAST(l_discount AS DOUBLE) - 0.05, 2) AS d, CAST(l_extendedprice AS DOUBLE) AS p, l_shipdate, l_tax FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN unit = 'kchar' THEN printf('%.2f', q) || ' kchar' ELSE CAST(CAST(floor(q + 0.5) AS BIGINT) AS VARCHAR) || ' ' || unit || CASE WHEN floor(q + 0.5) <> 1 THEN 's' ELSE '' END END AS quantity,
CASE WHEN abs(d) < 0.005 THEN '0.00σ' ELSE CASE WHEN d > 0 THEN '+' ELSE '' END || printf('%.2f', d) || 'σ' END AS sigma, strftime(l_shipdate, '%b %-d') AS week,
CASE WHEN l_linenumber % 2 = 0 THEN floor(p * 0.75) ELSE p END AS price, CASE WHEN CAST(l_tax AS DOUBLE) * 10 >= 0.6 THEN 'When this model gives a range, reality usually lands inside it.' ELSE 'Recent forecasts have been missing — the model is being retrained.' END AS coverage FROM u"""
)
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("minute", "kchar", "run", "month"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    double = lambda c: F.col(c).cast("double")
    return tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", labels.quantity(unit, unit, double("l_quantity")).alias("quantity"), labels.sigma(F.round(double("l_discount") - 0.05, 2)).alias("sigma"),
        labels.week(F.col("l_shipdate")).alias("week"), labels.price(double("l_extendedprice"), F.col("l_linenumber") % 2 == 0).alias("price"), labels.coverage(double("l_tax") * 10).alias("coverage"),
    )


@query(
    """WITH RECURSIVE m AS (SELECT label AS tenant_id, vec_id // 100 AS week, embedding AS e FROM embeddings),
a AS (SELECT tenant_id, week, i, avg(CAST(e[i] AS DOUBLE)) AS x FROM m, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT tenant_id, week, list(x ORDER BY i) AS c FROM a GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY week) AS k FROM c),
b(tenant_id, k, b) AS (SELECT tenant_id, k, c FROM n WHERE k = 1 UNION ALL SELECT n.tenant_id, n.k, list_transform(range(1, 65), lambda i: b.b[i] * 0.875 + n.c[i] * 0.125) FROM b JOIN n ON n.tenant_id = b.tenant_id AND n.k = b.k + 1),
s AS (SELECT tenant_id, week, avg(CAST(e[1] AS DOUBLE)) AS mean, stddev_pop(CAST(e[1] AS DOUBLE)) AS std FROM m GROUP BY ALL)
SELECT s.tenant_id, s.week, round(mean, 6) AS sentiment_mean, round(std, 6) AS sentiment_std,
round(coalesce(1 - list_dot_product(c, b) / ((sqrt(list_dot_product(c, c)) + 1e-9) * (sqrt(list_dot_product(b, b)) + 1e-9)), 0), 6) AS topic_drift
FROM s JOIN n USING (tenant_id, week) LEFT JOIN b ON b.tenant_id = n.tenant_id AND b.k = n.k - 1"""
)
def weekly_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are messages, a hundred a week; the first component stands for their sentiment."""
    messages = tables.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("tenant_id"), F.expr("vec_id div 100").cast("long").alias("week"), F.element_at("embedding", 1).cast("double").alias("sentiment"), "embedding"
    )
    rounded = [F.round(c, 6).alias(c) for c in ("sentiment_mean", "sentiment_std", "topic_drift")]
    return series.weekly_text(messages).select("tenant_id", "week", *rounded)


@query(
    """WITH c AS (SELECT o_custkey % 20 AS repo, md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderdate AS moment, o_orderkey FROM orders),
k AS (SELECT repo, max((moment, sha)) AS cursor FROM c WHERE o_orderkey % 97 = 0 AND repo < 15 GROUP BY 1),
f AS (SELECT c.*, row_number() OVER (PARTITION BY c.repo ORDER BY moment DESC, sha DESC) AS place FROM c LEFT JOIN k ON k.repo = c.repo WHERE cursor IS NULL OR (moment, sha) > cursor)
SELECT repo, sha, place FROM f WHERE place <= 500"""
)
def new_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are commits; of 15 of 20 repositories some commits have been seen, the others are new."""
    commits = tables.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("repo"), F.md5(F.col("o_orderkey").cast("string")).alias("sha"), F.col("o_orderdate").alias("at"), "o_orderkey")
    cursors = commits.where("o_orderkey % 97 = 0 AND repo < 15").select("repo", "sha")
    return ingestion.commits_since(commits.drop("o_orderkey"), cursors).select("repo", "sha", F.col("place").cast("long").alias("place"))


@query(
    """WITH w AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'RUNNING' ELSE 'DONE' END AS status, o_orderdate AS moment FROM orders)
SELECT owner, id, status FROM w WHERE status = 'PENDING' OR (status = 'RUNNING' AND moment < TIMESTAMP '1997-01-01' - INTERVAL 10 MINUTE) QUALIFY row_number() OVER (PARTITION BY owner ORDER BY moment, id) = 1"""
)
def claimable_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("DONE")
    work = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderdate").alias("at"))
    return ingestion.claimable(work, F.lit("1997-01-01").cast("timestamp_ntz")).select("owner", "id", "status")
