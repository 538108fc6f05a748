"""Drafts of knowledge blocks and standing rules: what may be saved, where it lands, and what sets a rule off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import strings

#: The types of blocks, the confidence from which a draft needs no review, and the events with the words that name them.
BLOCK_TYPES = ("meeting_summary", "forecast", "learned_fact", "pattern", "decision", "brief", "note")
AUTO_WRITE = 0.7
EVENT_SIGNALS = {
    "meeting_attended": r"\b(meetings?|standups?|calls?|syncs?)\b",
    "tft_forecast_completed": r"\b(forecasts?|tft|predictions?|projections?)\b",
    "document_processed": r"\b(documents?|emails?|pages?|files?|synced|ingested)\b",
    "daily_digest_due": r"\b(daily|weekly|digest|brief(ing)?|every (day|morning|week))\b",
}
DEFAULT_EVENT = "document_processed"


def draft_error(type_: Column, title: Column, body: Column, confidence: Column, author: Column) -> Column:
    """What is wrong with a draft, the first of all faults; null for one that may be saved."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    sure = F.coalesce((confidence >= 0) & (confidence <= 1) & ~F.isnan(confidence), F.lit(False))
    return (
        F.when(~F.coalesce(type_.isin(*BLOCK_TYPES), F.lit(False)), "type").when(blank(title), "title").when(blank(body), "body")
        .when(~sure, "confidence").when(~F.coalesce(author.isin("ai", "human"), F.lit(False)), "author")
    )


def gate(confidence: Column, author: Column) -> Column:
    """Where a draft lands: people's are active, others if they are confident enough, else they wait for a review."""
    return F.when((author == "human") | (confidence >= AUTO_WRITE), "active").otherwise("queued_for_review")


def standing_rule(prose: Column) -> Column:
    """Struct of name, triggers and persistence of a rule in prose; without a known trigger it fires on any processed document."""
    low = F.lower(prose)
    named = F.filter(F.array(*(F.when(low.rlike(words), event) for event, words in EVENT_SIGNALS.items())), lambda e: e.isNotNull())
    title = strings.truncate_words(strings.squeezed(prose), 60)
    return F.struct(
        F.when(F.coalesce(title, F.lit("")) == "", "Standing rule").otherwise(title).alias("name"),
        F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(DEFAULT_EVENT))).alias("triggers"),
        F.when(low.rlike(r"\buntil\b"), "until_date").otherwise("permanent").alias("persistence"),
    )


def fired(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Enabled rules beside the events that set them off: rules of tenant_id, triggers and enabled, events of tenant_id and event."""
    each = rules.where("enabled").withColumn("event", F.explode(F.array_distinct("triggers"))).drop("triggers", "enabled")
    return each.join(events, ["tenant_id", "event"])


def candidates(answers: DataFrame) -> DataFrame:
    """id, place, type, title, body, confidence of the drafts in a model's answers (id, answer): the outermost array of its fenced part, or of all of it.

    Answers that hold no array of JSON give none; entries without a title or a body are left out. Unknown types become learned facts, and a confidence outside 0 to 1, or none, 0.6.
    """
    fenced = F.regexp_extract("answer", r"(?si)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(F.when(fenced != "", fenced).otherwise(F.col("answer")), r"(?s)\[.*\]", 0)
    kind = "array<struct<type: string, title: string, body: string, confidence: string>>"
    each = answers.select("id", F.posexplode(F.from_json(inner, kind)).alias("place", "d"))
    sure = F.col("d.confidence").try_cast("double")
    found = each.select(
        "id", "place", F.when(F.col("d.type").isin(*BLOCK_TYPES), F.col("d.type")).otherwise("learned_fact").alias("type"), F.left(F.trim("d.title"), F.lit(120)).alias("title"),
        F.trim("d.body").alias("body"), F.when(sure.between(0, 1), sure).otherwise(0.6).alias("confidence"),
    )
    return found.where((F.col("title") != "") & (F.col("body") != ""))
