"""Append-only ledgers: balances, breakdowns, quotas, alerts, allowances, margins. Money stays decimal; every function takes its instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metered features with unit, credits and cost (micro-USD) of a unit, and names.
PRICE_BOOK = (
    ("meeting_agent", "minute", 1.0, 9_000, "meeting minute", "Meeting agent"),
    ("voice_synthesis", "kchar", 0.5, 2_400, "1k characters", "Voice"),
    ("bulk_ingest", "kdoc", 10.0, 40_000, "1k documents", "Bulk ingest"),
    ("forecast_target", "month", 50.0, 120_000, "target/month", "Forecast targets"),
    ("model_retrain", "run", 200.0, 800_000, "retrain run", "Model retraining"),
    ("api_request", "krequest", 2.0, 6_000, "1k requests", "API access"),
)
MONEY = "decimal(30,6)"


def half_up(x: Column, places: int = 2) -> Column:
    """Rounds halves towards positive infinity."""
    scale = 10**places
    return F.floor(x.cast("double") * scale + 0.5) / scale


def month_start(at: Column) -> Column:
    return F.date_trunc("MONTH", at).cast("date")


def within(frame: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows from start up to, and without, end; both are ISO dates, and the filter reaches the scan."""
    return frame.where((F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz")))


def balances(usage: DataFrame, credits: DataFrame, start: str, end: str) -> DataFrame:
    """tenant_id, granted, spent, balance of a period, for every tenant in either ledger."""
    granted = within(credits, "created_at", start, end).groupBy("tenant_id").agg(F.sum("credits").alias("granted"))
    spent = within(usage, "occurred_at", start, end).groupBy("tenant_id").agg(F.sum("credits").alias("spent"))
    zero = F.lit(0).cast(MONEY)
    both = granted.join(spent, "tenant_id", "full").select("tenant_id", F.coalesce(F.col("granted").cast(MONEY), zero).alias("granted"), F.coalesce(F.col("spent").cast(MONEY), zero).alias("spent"))
    return both.withColumn("balance", (F.col("granted") - F.col("spent")).cast(MONEY))


def reconcile(cached: DataFrame, ledger: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Tenants whose cached balance differs from the ledger's; a missing one counts as zero."""
    both = cached.select("tenant_id", F.col("balance").alias("cached")).join(ledger.select("tenant_id", "balance"), "tenant_id", "full").na.fill(0)
    return both.withColumn("drift", F.col("cached") - F.col("balance")).where(F.abs("drift") > tolerance)


def feature_breakdown(usage: DataFrame, start: str, end: str, top: int = 6) -> DataFrame:
    """Each tenant's ``top`` features by credits, with their share of what is shown."""
    spent = within(usage, "occurred_at", start, end).where("credits > 0").groupBy("tenant_id", "feature").agg(F.sum("credits").alias("credits"), F.sum("quantity").alias("quantity"))
    ranked = spent.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("credits"), "feature"))).where(F.col("rank") <= top)
    share = F.col("credits").cast("double") / F.sum(F.col("credits").cast("double")).over(Window.partitionBy("tenant_id"))
    return ranked.withColumn("share", share)


def daily(usage: DataFrame, start: str, end: str) -> DataFrame:
    return within(usage, "occurred_at", start, end).groupBy("tenant_id", F.to_date("occurred_at").alias("day"), "feature").agg(F.sum("credits").alias("credits"), F.count("*").alias("uses"))


def top_consumers(usage: DataFrame, start: str, end: str, top: int = 8) -> DataFrame:
    """Each tenant's ``top`` actors with their largest feature and their share of all actors' credits. Two aggregations, whatever the number of actors shown."""
    by_feature = within(usage, "occurred_at", start, end).groupBy("tenant_id", "actor", "feature").agg(F.sum("credits").alias("c"))
    largest = F.min_by("feature", F.struct(-F.col("c"), "feature"))  # of equal ones the smaller name
    by_actor = by_feature.groupBy("tenant_id", "actor").agg(F.sum("c").alias("credits"), largest.alias("top_feature"))
    totals = by_actor.groupBy("tenant_id").agg(F.sum("credits").alias("total"), F.count("*").alias("actors"))
    ranked = by_actor.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("credits"), "actor"))).where(F.col("rank") <= top)
    return ranked.join(totals, "tenant_id").select(
        "tenant_id", "rank", "actor", "credits", "top_feature", (F.col("credits").cast("double") / F.col("total").cast("double")).alias("share"), F.greatest(F.lit(0), F.col("actors") - top).alias("more")
    )


def projection_state(projected: Column, included: Column) -> Column:
    return F.when(included <= 0, "on_track").when(projected > included, "over").when(projected > included * 0.9, "near").otherwise("on_track")


def projection(usage: DataFrame, included: DataFrame, start: str, now: str, end: str) -> DataFrame:
    """used, the mean of the last seven days, what the period will come to at that rate, and what that means for the allowance."""
    at, spent = F.col("occurred_at"), F.col("credits")
    end_of, begin = F.lit(now).cast("timestamp_ntz"), F.lit(start).cast("timestamp_ntz")
    recent = (at >= end_of - F.expr("interval 7 days")) & (at < end_of)
    zero = F.lit(0).cast("decimal(20,6)")
    used = within(usage, "occurred_at", min(start, now), now).unionByName(within(usage, "occurred_at", "1900-01-01", start)).where(recent | (at >= begin)).groupBy("tenant_id").agg(
        F.sum(F.when(at >= begin, spent).otherwise(zero)).cast("double").alias("used"), (F.sum(F.when(recent, spent).otherwise(zero)).cast("double") / 7).alias("mean_7d")
    )
    days = (F.lit(end).cast("date").cast("timestamp").cast("long") - F.lit(now).cast("date").cast("timestamp").cast("long")) / 86400
    found = used.join(included, "tenant_id").withColumn("projected", F.col("used") + F.col("mean_7d") * days)
    return found.withColumn("state", projection_state(F.col("projected"), F.col("included")))


def projected_words(projected: DataFrame, now: str) -> DataFrame:
    """Adds to projection(): sentence, and exhausted_at, when an allowance that will be exceeded is used up at the present pace; null for others, and now if it is by now."""
    over, spare, share = F.col("projected") - F.col("included"), F.col("included") - F.col("projected"), F.col("projected") / F.col("included") * 100
    plain = lambda x: F.regexp_replace(F.format_string("%.2f", half_up(x)), r"\.?0+$", "")
    sentence = (
        F.when(F.col("included") <= 0, "Nothing metered this period. Chat, search, and forecasts are included and never use credits.")
        .when(F.col("state") == "over", F.concat(F.lit("Projected to exceed by about "), plain(over), F.lit(" credits.")))
        .when(F.col("state") == "near", F.concat(F.lit("Close — projected to use about "), F.floor(share + 0.5).cast("string"), F.lit("% of your allowance.")))
        .otherwise(F.concat(F.lit("On track — about "), plain(spare), F.lit(" credits to spare.")))
    )
    left, instant = F.col("included") - F.col("used"), F.lit(now).cast("timestamp_ntz")
    later = instant + F.make_dt_interval(secs=F.floor(F.greatest(left, F.lit(0.0)) / F.col("mean_7d") * 86400).cast("decimal(18,6)"))
    exhausted = F.when((F.col("state") == "over") & (F.col("mean_7d") > 0), F.when(left <= 0, instant).otherwise(later))
    return projected.select("*", sentence.alias("sentence"), exhausted.alias("exhausted_at"))


def receipts(usage: DataFrame, tenant: int, before: tuple[str, str] | None, limit: int) -> DataFrame:
    """A page of a tenant's rows, newest first, after the cursor (time, key); one row more than asked for tells that there is another page."""
    own = usage.where(F.col("tenant_id") == tenant)
    if before:
        at = F.lit(before[0]).cast("timestamp_ntz")
        own = own.where((F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("idempotency_key") < before[1])))
    return own.orderBy(F.desc("occurred_at"), F.desc("idempotency_key")).limit(limit + 1)


def quota(balance: DataFrame) -> DataFrame:
    """Adds decision: a feature's cap, then the hard cap, then no overage below the estimate; else ok, with will_go_negative.

    balance: spent, balance, estimate, feature_spent, feature_cap, hard_cap, overage; a null cap is no cap.
    """
    decision = (
        F.when(F.col("feature_spent") + F.col("estimate") > F.col("feature_cap"), "feature_cap")
        .when(F.col("spent") >= F.col("hard_cap"), "hard_cap").when(~F.col("overage") & (F.col("balance") < F.col("estimate")), "no_credits").otherwise("ok")
    )
    return balance.withColumn("decision", decision).withColumn("will_go_negative", (F.col("decision") == "ok") & (F.col("balance") - F.col("estimate") < 0))


def alerts(spent: DataFrame, configured: list[int], fired: DataFrame | None = None) -> DataFrame:
    """tenant_id, threshold and percent for each configured threshold, and 100, that the spent share has reached and that hasn't fired yet."""
    percent = F.floor(100 * F.col("spent").cast("double") / F.col("included")).cast("long")
    reached = spent.where("included > 0").select("tenant_id", percent.alias("percent"), F.explode(F.array(*map(F.lit, sorted({*configured, 100})))).alias("threshold")).where("percent >= threshold")
    return reached if fired is None else reached.join(fired, ["tenant_id", "threshold"], "left_anti")


def margins(usage: DataFrame, credits: DataFrame, monthly_price: float, pack_price: float, least: float = 0.4) -> DataFrame:
    """Each tenant's weeks: cost, largest cost's feature, revenue (a quarter of the monthly price and purchases), margin, and flagged.

    A week is flagged if its margin and that of the very week before are below ``least``.
    """
    week = F.date_trunc("WEEK", "occurred_at").cast("date").alias("week")
    by_feature = usage.groupBy("tenant_id", week, "feature").agg(F.sum("cost_micros").alias("c"))
    cost = by_feature.groupBy("tenant_id", "week").agg(F.sum("c").alias("cost_micros"), F.max_by("feature", F.struct("c", "feature")).alias("top_feature"))
    bought = credits.where("kind = 'purchase'").groupBy("tenant_id", F.date_trunc("WEEK", "created_at").cast("date").alias("week")).agg(F.count("*").alias("purchases"))
    revenue = F.lit(monthly_price) / 4 + F.coalesce("purchases", F.lit(0)) * pack_price
    found = cost.join(bought, ["tenant_id", "week"], "left").withColumn("revenue", revenue)
    found = found.withColumn("margin", (F.col("revenue") - F.col("cost_micros")) / F.col("revenue")).drop("purchases")
    order = Window.partitionBy("tenant_id").orderBy("week")
    before = (F.lag("margin").over(order) < least) & (F.lag("week").over(order) == F.date_sub("week", 7))
    return found.withColumn("flagged", (F.col("margin") < least) & F.coalesce(before, F.lit(False)))


def idempotent(incoming: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Rows to append: usable ones (a key, a finite quantity of at least zero), of each key the smallest, and none that the ledger has.

    Rows are compared column by column, so that the same one is kept whatever order they come in.
    """
    quantity = F.col("quantity").cast("double")
    usable = incoming.where((F.col("idempotency_key") != "") & ~F.isnan(quantity) & (quantity >= 0) & (quantity < float("inf")))
    rest = [c for c in incoming.columns if c != "idempotency_key"]
    once = usable.groupBy("idempotency_key").agg(F.min(F.struct(*rest)).alias("_row")).select("idempotency_key", "_row.*").select(*incoming.columns)
    return once if ledger is None else once.join(ledger.select("idempotency_key"), "idempotency_key", "left_anti")


# --- rows to append ---------------------------------------------------------------------------------------------

#: How many of what is counted make a unit, for units of a thousand.
SIZES = {"kchar": 1000, "kdoc": 1000, "krequest": 1000}
#: Features that are never charged.
UNMETERED = ("chat", "search", "forecast_view", "brain_view", "connector_sync")


def cost_micros(quantity: Column, per_unit: Column) -> Column:
    """Cost in micro-USD: the quantity is rounded to millionths first, then what is below one micro is cut off. Exact, in whole numbers."""
    scaled = F.floor(quantity.cast("double") * 1_000_000 + 0.5).cast("decimal(20,0)")
    return F.floor(scaled * per_unit.cast("decimal(12,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("long")


def metered(uses: DataFrame) -> DataFrame:
    """Ledger rows of uses (tenant_id, feature, counted, idempotency_key): quantity in units, credits and cost_micros; uses of nothing and unknown features give none.

    counted: minutes of a meeting, characters spoken, documents beyond the allowance, targets of a month, runs, requests.
    """
    rows = {name: (unit, credits, cost, SIZES.get(unit, 1)) for name, unit, credits, cost, *_ in PRICE_BOOK}
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for f, row in rows.items() for x in (f, row[i]))), F.col("feature"))
    quantity = F.col("counted") / of(3)
    known = uses.where(F.col("feature").isin(*rows) & (F.col("counted") > 0))
    return known.select("tenant_id", "feature", of(0).alias("unit"), quantity.alias("quantity"), (quantity * of(1)).alias("credits"), cost_micros(quantity, of(2)).alias("cost_micros"), "idempotency_key")


def unmetered(uses: DataFrame) -> DataFrame:
    """Ledger rows of uses that nobody is charged for, one for each key: zero credits, what they did cost, and metadata that says so.

    uses: tenant_id, feature (one of UNMETERED, others give no row), quantity and unit (null: one run), cost_micros, metadata (map of strings, or null) and
    idempotency_key. Of rows with one key the smallest is taken, compared by their columns; rows without a key or with a cost below zero give none.
    """
    good = uses.where(F.col("feature").isin(*UNMETERED) & (F.col("idempotency_key") != "") & (F.coalesce("cost_micros", F.lit(0)) >= 0))
    told = F.map_concat(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("unmetered"), F.lit("true")))
    shown = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.map_filter(told, lambda k, v: v.isNotNull())))))
    rows = good.select(
        "tenant_id", "feature", F.coalesce(F.col("quantity").cast("double"), F.lit(1.0)).alias("quantity"), F.coalesce("unit", F.lit("run")).alias("unit"), F.lit(0.0).alias("credits"),
        F.coalesce(F.col("cost_micros").cast("long"), F.lit(0)).alias("cost_micros"), shown.alias("metadata"), "idempotency_key",
    )
    rest = [c for c in rows.columns if c != "idempotency_key"]
    return rows.groupBy("idempotency_key").agg(F.min(F.struct(*rest)).alias("r")).select("r.*", "idempotency_key")


def model_calls(calls: DataFrame) -> DataFrame:
    """Calls of a language model (tenant_id, request_id, surface, model, input_tokens, output_tokens, cost_micros) as unmetered uses: searches count as search, all others as chat."""
    told = F.map_from_entries(F.array(*(F.struct(F.lit(name), F.col(name).cast("string")) for name in ("model", "input_tokens", "output_tokens", "surface"))))
    rows = calls.select(
        "tenant_id", F.when(F.col("surface") == "search", "search").otherwise("chat").alias("feature"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), "cost_micros",
        told.alias("metadata"), F.concat(F.lit("llm:"), F.col("request_id").cast("string")).alias("idempotency_key"),
    )
    return unmetered(rows)


def corrections(refunds: DataFrame) -> DataFrame:
    """Rows that give credits back for an event (tenant_id, feature, event_id, credits): negative credits, no quantity, no cost, one for each event, of several the largest."""
    good = refunds.where((F.col("credits") > 0) & F.col("event_id").isNotNull())
    once = good.groupBy("tenant_id", "event_id").agg(F.max(F.struct("credits", "feature")).alias("r"))
    return once.select(
        "tenant_id", "r.feature", F.lit(0.0).alias("quantity"), (-F.col("r.credits")).alias("credits"), F.lit(0).cast("long").alias("cost_micros"), F.concat(F.lit("correction:"), "event_id").alias("idempotency_key")
    )


def purchases(events: DataFrame) -> DataFrame:
    """Credits granted for a provider's events (tenant_id, event_id, credits): positive finite ones, once for each event however often it is delivered."""
    credits = F.col("credits").cast("double")
    good = events.where(F.col("event_id").isNotNull() & ~F.isnan(credits) & (credits > 0) & (credits < float("inf")))
    once = good.groupBy("event_id").agg(F.min(F.struct("tenant_id", "credits")).alias("r"))
    return once.select("r.tenant_id", F.lit("purchase").alias("kind"), "r.credits", F.col("event_id").alias("idempotency_key"))


def ingest_batches(batches: DataFrame, included_docs: Column) -> DataFrame:
    """Two kinds of rows for batches (tenant_id, batch_id, at, documents) of one period: the whole volume without credits, and what exceeds the tenant's included documents with them.

    What is left of the allowance is what earlier batches, by time and id, didn't use. A batch that comes twice counts once; empty ones give no rows.
    """
    once = batches.where(F.col("documents") > 0).groupBy("tenant_id", "batch_id").agg(F.min(F.struct("at", "documents")).alias("b")).select("tenant_id", "batch_id", "b.at", "b.documents")
    before = F.coalesce(F.sum("documents").over(Window.partitionBy("tenant_id").orderBy("at", "batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    excess = F.greatest(F.lit(0), F.col("documents") - F.greatest(F.lit(0), included_docs - before))
    _, unit, credits, cost, *_ = next(row for row in PRICE_BOOK if row[0] == "bulk_ingest")
    size = SIZES[unit]
    row = lambda feature, docs, price, key: F.struct(
        F.lit(feature).alias("feature"), (docs / size).alias("quantity"), (docs / size * price).alias("credits"), cost_micros(docs / size, F.lit(cost)).alias("cost_micros"), F.concat(F.lit(key), F.col("batch_id").cast("string")).alias("idempotency_key")
    )
    rows = F.array(row("connector_sync", F.col("documents"), 0.0, "ingest-volume:"), row("bulk_ingest", F.col("_excess"), credits, "ingest:"))
    return once.withColumn("_excess", excess).select("tenant_id", F.explode(rows).alias("r")).select("tenant_id", "r.*").where("quantity > 0").withColumn("unit", F.lit(unit))
