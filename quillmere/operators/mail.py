"""Mail as it comes from a provider: nested part trees walked level by level, bodies, and a merge that updates only some columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.sources import staging

_HEADERS = "array<struct<name:string,value:string>>"
#: What a row has of its first landing, and what later ones change.
CREATED = ("thread_id", "subject", "sender", "recipient", "sent_at", "body_text", "body_html")
UPDATED = ("labels", "snippet")


def decoded(data: Column) -> Column:
    """Base64 of either alphabet, with or without padding, as text; bytes that aren't UTF-8 become U+FFFD, and what isn't base64 is empty."""
    plain = F.regexp_replace(F.translate(data, "-_", "+/"), "[=\\s]", "")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.coalesce(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), F.lit(""))


def header(headers: Column, name: str) -> Column:
    """The value of the first header of that name, in any case of letters."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def sent_time(date: Column) -> Column:
    """A Date header such as ``Mon, 5 Jan 2026 10:00:00 +0100 (CET)``; null if it isn't one."""
    found = r"(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}:\d{2})(:\d{2})?\s*([+-]\d{4})?"
    part = lambda i: F.regexp_extract(date, found, i)
    seconds, zone = F.coalesce(F.nullif(part(5), F.lit("")), F.lit(":00")), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("+0000"))
    return F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3), F.concat(part(4), seconds), zone), F.lit("d MMM yyyy H:mm:ss xx"))


def parts(messages: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, path, mime and data of every part of every tree, the payload itself included, as a written table.

    payload: a VARIANT with mimeType, body.data and parts. One level of all trees is taken at a time, for as many levels as the deepest has. path has the
    part's place at each level, so that paths in order are the order of a walk.
    """
    level = messages.select(*keys, F.array().cast("array<int>").alias("path"), F.col(payload).alias("part"))
    done, nested = [], []
    while True:
        text = lambda where, frame=level: F.try_variant_get("part", where, "string")
        done.append(staging.written(level.select(*keys, "path", text("$.mimeType").alias("mime"), text("$.body.data").alias("data")), "mail-parts"))
        below = level.select(*keys, "path", F.posexplode(F.try_variant_get("part", "$.parts", "array<variant>")).alias("place", "part"))
        level = staging.written(below.select(*keys, F.concat("path", F.array("place")).alias("path"), "part"), "mail-level")
        nested.append(level)
        if level.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    found = staging.written(out, "mail-walk")
    staging.discard(*done, *nested)
    return found


def bodies(messages: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """keys, body_text and body_html: the decoded text/plain and text/html parts, each kind joined in the order of the walk; null if there is nothing."""
    found = parts(messages, keys, payload).where(F.col("mime").isin("text/plain", "text/html")).select(*keys, "mime", "path", decoded(F.col("data")).alias("body"))

    def of(mime: str) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col("mime") == mime, F.struct("path", "body"))))
        return F.nullif(F.array_join(F.transform(own, lambda x: x["body"]), ""), F.lit(""))

    return found.groupBy(*keys).agg(of("text/plain").alias("body_text"), of("text/html").alias("body_html"))


def rows(landed: DataFrame) -> DataFrame:
    """Rows of landed messages (connection_id, seq, message: JSON as the provider gives it); what isn't JSON or has no id gives none.

    seq orders the landings of a connection; no two landings of one connection share it.
    """
    # Written, so that each message is parsed once and not again for every field, filter and level that reads it.
    parsed = staging.written(landed.select("connection_id", "seq", F.try_parse_json("message").alias("m")), "mail-parsed")
    read = parsed.where("m IS NOT NULL")
    text = lambda where: F.try_variant_get("m", where, "string")
    whole = read.select(
        "connection_id", "seq", text("$.id").alias("message_id"), text("$.threadId").alias("thread_id"), F.coalesce(F.try_variant_get("m", "$.labelIds", "array<string>"), F.array().cast("array<string>")).alias("labels"),
        text("$.snippet").alias("snippet"), F.coalesce(F.try_variant_get("m", "$.payload.headers", _HEADERS), F.array().cast(_HEADERS)).alias("headers"), F.try_variant_get("m", "$.payload", "variant").alias("payload"),
    ).where("message_id IS NOT NULL")
    found = bodies(whole.where("payload IS NOT NULL").select("connection_id", "seq", "payload"), ["connection_id", "seq"])
    h = lambda name: header(F.col("headers"), name)
    own = whole.select(
        "connection_id", "seq", "message_id", "thread_id", "labels", "snippet", h("Subject").alias("subject"), h("From").alias("sender"), h("To").alias("recipient"), sent_time(h("Date")).alias("sent_at")
    )
    return own.join(found, ["connection_id", "seq"], "left")


def merged(landed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The stored rows with landed ones merged in: a new message is a PENDING row as it first landed, and each landing changes labels and snippet only.

    landed: rows(). stored: connection_id, message_id, status and the columns of rows(), without seq; null for none. A body that came first stays, whatever comes later.
    """
    new = landed.withColumn("status", F.lit("PENDING"))
    if stored is not None:
        new = new.unionByName(stored.withColumn("seq", F.lit(-1).cast("long")))
    merged_rows = new.groupBy("connection_id", "message_id").agg(
        F.min_by(F.struct(*CREATED, "status"), "seq").alias("created"), F.max_by(F.struct(*UPDATED), "seq").alias("updated")
    )
    return merged_rows.select("connection_id", "message_id", "created.*", "updated.*")


def payloads(landed: DataFrame, table: DataFrame, users: DataFrame) -> DataFrame:
    """What goes to the queue: every message that landed, once, changed or not, as its row is now. users: connection_id, user_id."""
    own = landed.select("connection_id", "message_id").distinct().join(table, ["connection_id", "message_id"]).join(users, "connection_id")
    return own.select(
        F.concat_ws(":", "connection_id", "message_id").alias("raw_document_id"), F.lit("gmail").alias("source"), F.col("message_id").alias("external_id"),
        F.coalesce(F.nullif("sender", F.lit("")), F.lit("Unknown")).alias("author"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body_text", "body_html", F.lit("")).alias("content"),
        F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.to_json(F.struct("thread_id", "labels")).alias("metadata"), F.col("connection_id").alias("connector_id"),
        F.concat_ws(":", F.col("user_id"), F.lit("gmail")).alias("namespace"),
    )
