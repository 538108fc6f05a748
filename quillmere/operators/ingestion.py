"""Staging, due syncs, retries, retention and the like: predicates and state changes over status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Minutes between syncs of mail and of the rest, after which a lock is stale, and days and hours of retention and retry.
MAIL_MINUTES, OTHER_MINUTES, STALE_LOCK_MINUTES = 5, 180, 15
RETENTION_DAYS, RETRY_HOURS = 30, 24
CARRIED = ("title", "url", "path", "language", "repository", "author", "channel", "thread", "kind", "part", "line", "sha", "folder")
REQUIRED = ("raw_document_id", "source", "external_id", "content", "timestamp", "namespace")


def rejected(payloads: DataFrame) -> DataFrame:
    """Adds error: the first required field that is missing or blank, null for rows that may pass."""
    missing = F.coalesce(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in REQUIRED))
    return payloads.withColumn("error", missing)


def parsed_time(ts: Column) -> Column:
    """Seconds or (above 1e11) milliseconds since 1970 or an ISO string to a timestamp; else null."""
    seconds = ts.try_cast("double")
    return F.when(seconds > 1e11, F.timestamp_millis(seconds.cast("long"))).when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(ts))


def author(a: Column) -> Column:
    return F.left(F.coalesce(F.nullif(F.trim(a), F.lit("")), F.lit("Unknown")), F.lit(256))


def namespace(user: Column, scope: Column) -> Column:
    return F.when(F.coalesce(F.trim(user), F.lit("")) == "", F.raise_error(F.lit("a namespace needs a user"))).otherwise(F.concat_ws(":", user, scope))


def carried(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: k.isin(*CARRIED) & v.isNotNull())


def due(state: DataFrame, now: Column) -> DataFrame:
    """Adds due, locked and runs to rows of source, last_synced and syncing_since; what never ran is due."""
    minutes = lambda c: (now.cast("timestamp").cast("double") - F.col(c).cast("timestamp").cast("double")) / 60
    every = F.when(F.col("source") == "gmail", MAIL_MINUTES).otherwise(OTHER_MINUTES)
    found = state.withColumn("due", F.col("last_synced").isNull() | (minutes("last_synced") >= every))
    found = found.withColumn("locked", F.coalesce(minutes("syncing_since") < STALE_LOCK_MINUTES, F.lit(False)))
    return found.withColumn("runs", F.col("due") & ~F.col("locked"))


def retried(status: DataFrame, now: Column) -> DataFrame:
    """FAILED rows of the last day become PENDING."""
    at = F.coalesce("processed_at", "queued_at")
    again = (F.col("status") == "FAILED") & (at > now - F.expr(f"interval {RETRY_HOURS} hours"))
    return status.withColumn("status", F.when(again, "PENDING").otherwise(F.col("status")))


def retained(status: DataFrame, now: Column) -> DataFrame:
    return status.where(~((F.col("status") == "PROCESSED") & (F.col("processed_at") < now - F.expr(f"interval {RETENTION_DAYS} days"))) | F.col("processed_at").isNull())


def storage_class(age_days: Column, status: Column) -> Column:
    return F.when(status != "PROCESSED", "STANDARD").when(age_days > 730, "GLACIER").when(age_days > 90, "STANDARD_IA").otherwise("STANDARD")


def latest_status(log: DataFrame) -> DataFrame:
    """The newest row of each document in an append-only status log."""
    return log.groupBy("doc_id").agg(F.max_by(F.struct("status", "at", "error"), F.struct("at", "status")).alias("s")).select("doc_id", "s.status", "s.at", "s.error")


def unchanged_skipped(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows of key and version that the store doesn't have in that version."""
    return incoming.join(stored.select("key", "version"), ["key", "version"], "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store with incoming rows in place of those with their key; of several incoming ones the newest version."""
    newest = incoming.withColumn("_p", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))).where("_p = 1").drop("_p")
    return stored.join(newest.select("key"), "key", "left_anti").unionByName(newest)


def staged(sources: list[tuple[str, DataFrame]], connections: DataFrame, workflow: int) -> DataFrame:
    """source, id, status of a workflow's PENDING rows from all staging tables: blank ones are done, the others queued."""
    own = connections.where(F.col("workflow_id") == workflow).select("connection_id")
    out = None
    for name, rows in sources:
        part = rows.where("status = 'PENDING'").join(own, "connection_id").select(F.lit(name).alias("source"), "id", F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "PROCESSED").otherwise("QUEUED").alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


# --- sealed columns ---------------------------------------------------------------------------------------------


def tenant_key(tenant: Column, master: str) -> Column:
    """A tenant's 256-bit key, derived from a master secret; without the secret none can be made again."""
    return F.unhex(F.sha2(F.concat_ws("|", F.lit(master), F.sha2(F.concat_ws("|", F.lit(master), tenant), 256)), 256))


def sealed(value: Column, key: Column, tenant: Column) -> Column:
    """AES-GCM under a random nonce, which stands before the ciphertext; the tenant is authenticated with it."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), tenant)


def opened(value: Column, key: Column, tenant: Column) -> Column:
    """The sealed string; null where key, tenant or bytes don't fit."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), tenant).cast("string")


# --- rows of connectors -----------------------------------------------------------------------------------------


def worth_ingesting(subtype: Column, bot: Column, text: Column) -> Column:
    """Chat messages that people wrote: no notices, no bots, and more than one character."""
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return missing(subtype) & missing(bot) & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 1)


def chat_time(ts: Column) -> Column:
    """The instant of seconds with a suffix, such as 1723473000.001200, to the millisecond; null where it is no number."""
    return F.timestamp_millis(F.floor(ts.try_cast("double") * 1000))


def mail_query(since: Column, overlap_s: int = 120) -> Column:
    """The cursor that an incremental run asks for: seconds since the epoch, some earlier than the last run; null for a first run."""
    seconds = F.greatest(F.lit(0), F.unix_seconds(since.cast("timestamp")) - overlap_s)
    return F.when(since.isNotNull(), F.concat(F.lit("after:"), seconds.cast("string")))


def commits_since(commits: DataFrame, cursors: DataFrame, most: int = 500) -> DataFrame:
    """Commits of repo, sha and at above each repository's cursor (repo, sha), the newest ``most``; all of them where the cursor isn't found.

    Equal times are told apart by sha. The cursor's place is joined, so that no repository's log is walked.
    """
    place = cursors.join(commits, ["repo", "sha"]).groupBy("repo").agg(F.max(F.struct("at", "sha")).alias("_cursor"))
    newer = commits.join(place, "repo", "left").where(F.col("_cursor").isNull() | (F.struct("at", "sha") > F.col("_cursor"))).drop("_cursor")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("at"), F.desc("sha")))
    return newer.withColumn("place", rank).where(F.col("place") <= most)


def claimable(work: DataFrame, now: Column, stale_minutes: int = 10) -> DataFrame:
    """Of each owner's work (id, owner, status, at) the oldest that waits, or that a run left behind so long ago that it may be taken over."""
    left = (F.col("status") == "RUNNING") & (F.col("at") < now - F.expr(f"interval {stale_minutes} minutes"))
    return work.where((F.col("status") == "PENDING") | left).groupBy("owner").agg(F.min(F.struct("at", "id", "status")).alias("w")).select("owner", "w.id", "w.status", "w.at")
