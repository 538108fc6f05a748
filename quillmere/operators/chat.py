"""Chat messages as changes fold into rows: a message is created once, and each edit renews some of its columns and makes it PENDING again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import ingestion

#: A message is known by these.
KEY = ("connection_id", "channel_id", "message_ts")
#: What a row has of its first change, and what later ones renew.
CREATED, RENEWED = ("thread_ts", "author_id"), ("text", "author_name", "channel_name")


def changes(messages: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """KEY, CREATED, RENEWED and seq of the messages that are worth keeping: no notices, bots or empty texts.

    messages: connection_id, channel_id, channel_name, ts, thread_ts, user, text, subtype, bot_id, seq (the order of a message's changes).
    users: user, name; who isn't there is named by the identifier, and no one by ''. thread is the message that a reply belongs to, or the message itself.
    """
    kept = messages.where(ingestion.worth_ingesting(F.col("subtype"), F.coalesce("bot_id", F.lit("")), F.col("text")))
    if users is None:
        named = kept.withColumn("name", F.lit(None).cast("string"))
    else:
        named = kept.join(users.groupBy("user").agg(F.max("name").alias("name")), "user", "left")
    return named.select(
        "connection_id", "channel_id", F.col("ts").alias("message_ts"), "thread_ts", F.col("user").alias("author_id"), "text", F.coalesce("name", "user", F.lit("")).alias("author_name"), "channel_name", "seq",
        F.coalesce("thread_ts", "ts").alias("thread"),
    )


def folded(changed: DataFrame) -> DataFrame:
    """One row for each message of changes(): as it was created, with what the last change made of it. edited: whether there was more than one change."""
    rows = changed.groupBy(*KEY).agg(
        F.min_by(F.struct(*CREATED, "thread"), F.struct("seq", *CREATED)).alias("first"), F.max_by(F.struct(*RENEWED), F.struct("seq", *RENEWED)).alias("last"), F.max("seq").alias("seq"), F.min("seq").alias("_from")
    )
    return rows.select(*KEY, "first.*", "last.*", "seq", (F.col("seq") > F.col("_from")).alias("edited"))


def merged(changed: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored rows (KEY, CREATED, RENEWED, status) with changes merged in: what changed is PENDING, whatever it was; new messages are rows of their own."""
    now = folded(changed)
    both = now.alias("n").join(stored.alias("s"), list(KEY), "full")
    old, new = F.col("s.status").isNotNull(), F.col("n.seq").isNotNull()
    created = [F.when(old, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in CREATED]
    renewed = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in RENEWED]
    return both.select(*KEY, *created, *renewed, F.when(new, "PENDING").otherwise(F.col("s.status")).alias("status"))


def payloads(rows: DataFrame, users: DataFrame) -> DataFrame:
    """What goes to the queue of folded() rows. users: connection_id, user_id."""
    named = F.nullif("channel_name", F.lit(""))
    return rows.join(users, "connection_id").select(
        F.concat_ws(":", *KEY).alias("raw_document_id"), F.lit("slack").alias("source"), F.concat_ws(":", "channel_id", "message_ts").alias("external_id"), F.col("author_name").alias("author"),
        F.coalesce(F.concat(F.lit("#"), named), F.lit("Slack message")).alias("subject"), F.col("text").alias("content"), ingestion.chat_time(F.col("message_ts")).alias("timestamp"),
        F.struct("channel_id", "channel_name", "thread_ts", F.coalesce(F.col("thread_ts") != F.col("message_ts"), F.lit(False)).alias("is_reply")).alias("metadata"),
        F.col("connection_id").alias("connector_id"), F.concat_ws(":", "user_id", F.lit("slack")).alias("namespace"),
    )


def threads(rows: DataFrame) -> DataFrame:
    """connection_id, channel_id, thread, n and document of folded() rows: a thread's messages in the order of their times, each as ``name: text``."""
    line = F.struct(F.col("message_ts").cast("decimal(20,6)").alias("at"), "message_ts", F.concat_ws(": ", F.nullif("author_name", F.lit("")), "text").alias("line"))
    held = rows.groupBy("connection_id", "channel_id", "thread").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(line)).alias("lines"))
    return held.select("connection_id", "channel_id", "thread", "n", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("document"))
