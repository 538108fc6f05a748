"""Vector search, regrouping of chunks, ranking with lexical boosts and caps, and what a question asks for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that carry no meaning in a question, the words that name a source, and the patterns of intents.
STOP_WORDS = """
a about all an and any are as at be been but by can did do does for from get give had has have how i in is it its just list made make
me my of on or our out show so tell that the their them there these they this to up us was we were what when where which who whom why
will with would you your
""".split()
SOURCE_KEYWORDS = {
    "gmail": ["email", "emails", "e-mail", "e-mails", "gmail", "mail", "mails", "inbox"],
    "notion": ["notion", "page", "pages", "wiki"],
    "github": ["github", "git", "code", "codes", "repo", "repos", "repository", "repositories", "pr", "prs", "pull request", "pull requests", "issue", "issues", "commit", "commits"],
    "slack": ["slack", "channel", "channels"],
    "drive": ["drive", "google drive", "gdrive", "google docs", "spreadsheet", "spreadsheets", "sheet", "sheets"],
    "upload": ["upload", "uploads", "uploaded", "file", "files", "document", "documents", "attachment", "attachments", "pdf", "pdfs"],
    "brain": ["brain", "memory", "memories", "knowledge base"],
    "custom": ["webhook", "webhooks"],
}
CONFIG_SIGNALS = r"\b(configure|set (yourself|your self|myself|it) up|from now on|going forward|always|every time|whenever|each time|standing (rule|instruction)|act as|behave as)\b"
WRITE_VERBS = r"\b(add|update|write|record|note|log|append|save|store|put|insert)\b"
QUERY_SIGNALS = r"\b(what|who|when|where|why|how|which|show me|find|list|search|summari[sz]e for me|tell me|do (i|we) have|did (i|we))\b"
PEOPLE = r"\bwho(m|se)?\b|\b(devs?|developers?|engineers?|team|teammates?|members?|staff|colleagues?|people|everyone|roster|assignees?|owners?)\b"
CODE_NOUNS = r"\b(code|file|function|method|class|module|component|endpoint|route|handler|config|schema|test|script|api|pipeline|repo|repository)\b"
CODE_PLACES = r"\b(where|which file|what file|show me the (code|file|function|class)|implementation|implemented|defined|declared|source code|code ?base|in the (repo|repository|code)|function|method|class|module|import|export)\b"
BLOCK_TYPES = (
    ("decision", r"\b(decided|decision|agreed|final(ised|ized)?|approved)\b"),
    ("meeting_summary", r"\b(meeting|standup|sync|call)\b"),
    ("forecast", r"\b(forecast|predict|projection|trajectory)\b"),
    ("learned_fact", r"\b(devs?|developers?|engineers?|team|teammates?|members?|staff|colleagues?|roster|assignees?|owners?|owns|owned by|assigned to|works? on|responsible for)\b"),
    ("learned_fact", r"\b(always|fact|policy|our (hq|office|fiscal)|is located)\b"),
    ("pattern", r"\b(trend|pattern|anomaly|spike|drop)\b"),
)


# --- vectors ----------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column) -> Column:
    """A vector of length one; one that is (nearly) zero stays."""
    return F.transform(v, lambda x: F.when(norm(v) < 1e-10, x.cast("double")).otherwise(x.cast("double") / norm(v)))


def scored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vec_id, source, score: the cosine to the one query vector, in a scan without a shuffle of the vectors."""
    q = F.broadcast(query.select(F.col("embedding").alias("q")).limit(1))
    return vectors.crossJoin(q).select("vec_id", "source", (dot(F.col("embedding"), F.col("q")) / (norm(F.col("embedding")) * norm(F.col("q")))).alias("score"))


def top(scores: DataFrame, k: int, least: float | None = None) -> DataFrame:
    found = scores if least is None else scores.where(F.col("score") >= least)
    return found.orderBy(F.desc("score"), "vec_id").limit(k)


def top_per_source(scores: DataFrame, k: int) -> DataFrame:
    """The best k of each source, so that none crowds the others out."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


# --- documents --------------------------------------------------------------------------------------------------


def regrouped(chunks: DataFrame) -> DataFrame:
    """One row for each document: text of its chunks in order without repeats, best score, the source of its first chunk, the best chunk's place."""
    first = chunks.groupBy("doc", F.trim("text").alias("t")).agg(F.min("chunk_index").alias("i"), F.max("score").alias("s"), F.min_by("source", "chunk_index").alias("source"))
    parts = F.array_sort(F.collect_list(F.struct("i", "t")))
    return first.where("doc IS NOT NULL").groupBy("doc").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"), F.max("s").alias("best_score"), F.min_by("source", "i").alias("source"),
        F.max_by("i", F.struct("s", -F.col("i"))).alias("best_chunk"), F.count("*").alias("chunks"),
    )


def heading(text: Column) -> Column:
    """A document's heading: its first line that isn't blank, if it is marked as one or reads like one; else empty."""
    line = F.trim(F.coalesce(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(1)), F.lit("")))
    return F.when(line.rlike(r"^#+\s"), F.trim(F.regexp_replace(line, r"^#+\s*", ""))).when((F.length(line) <= 80) & ~line.rlike(r"\.\s"), line).otherwise("")


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def lexical_boost(terms: list[str], text: Column) -> Column:
    """Half for terms in the heading (a long one may have one edit), a tenth for terms in the text alone, each by their share of the terms."""
    if not terms:
        return F.lit(0.0)
    tokens = F.filter(F.split(F.lower(heading(text)), "[^a-z0-9]+"), lambda t: t != "")
    body = F.lower(text)

    def close(term: str) -> Column:
        return F.exists(tokens, lambda t: (F.length(t) >= 6) & (F.levenshtein(t, F.lit(term), 1) >= 0)) if len(term) >= 6 else F.lit(False)

    total = F.lit(0.0)
    for term in terms:
        total = total + F.when(F.array_contains(tokens, term) | close(term), 0.5).when(F.contains(body, F.lit(term)), 0.1).otherwise(0.0)
    return total / len(terms)


def ranked(docs: DataFrame, terms: list[str], cap: int, most: int, caps: dict[str, int] | None = None) -> DataFrame:
    """Documents by best score and boost: of equal beginnings the best one, at most ``cap`` (or caps[source]) of a source, ``most`` in all."""
    rank = docs.withColumn("rank_score", F.col("best_score") + lexical_boost(terms, F.col("text")))
    same = F.row_number().over(Window.partitionBy(F.left(F.trim("text"), F.lit(400))).orderBy(F.desc("rank_score"), "doc"))
    once = rank.withColumn("_same", same).where("_same = 1").drop("_same")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("rank_score"), "doc"))
    limit = F.lit(cap)
    for source, own in (caps or {}).items():
        limit = F.when(F.col("source") == source, own).otherwise(limit)
    return once.withColumn("place", place).where(F.col("place") <= limit).orderBy(F.desc("rank_score"), "doc").limit(most)


# --- questions --------------------------------------------------------------------------------------------------


def source_intent(query: Column) -> Column:
    """Names of the sources that a question speaks of, in their order, joined by commas."""
    low, found = F.lower(query), []
    for source, words in SOURCE_KEYWORDS.items():
        single = "|".join(w for w in words if " " not in w and "-" not in w)
        said = low.rlike(rf"\b({single})\b")
        for phrase in (w for w in words if " " in w or "-" in w):
            said = said | F.contains(low, F.lit(phrase))
        found.append(F.when(said, source))
    return F.concat_ws(",", *found)


def intent(prose: Column, has_target: Column) -> Column:
    """Struct of intent and confidence: a standing rule before a change, a change before a question."""
    low = F.lower(prose)
    config, write, asks = low.rlike(CONFIG_SIGNALS), has_target & low.rlike(WRITE_VERBS), low.rlike(QUERY_SIGNALS)
    of = lambda name, c: F.struct(F.lit(name).alias("intent"), c.alias("confidence"))
    return (
        F.when(config, of("CONFIG", F.when(write | has_target, 0.9).otherwise(0.8))).when(write & ~asks, of("WRITE", F.lit(0.85)))
        .when(write, of("WRITE", F.lit(0.5))).otherwise(of("QUERY", F.when(asks, 0.9).otherwise(0.7)))
    )


def block_type(prose: Column) -> Column:
    found = F
    for name, pattern in BLOCK_TYPES:
        found = found.when(F.lower(prose).rlike(pattern), name)
    return found.otherwise("note")


# --- scopes and interleaving ------------------------------------------------------------------------------------


def scope(mentioned: Column, targets: Column, intent: Column, prose: Column) -> Column:
    """Sources that a search is limited to, none for all: those that are mentioned as context, else, when reading, those that pages name, else those of the prose."""
    known = F.array(*map(F.lit, sorted(SOURCE_KEYWORDS)))
    own, pages = F.array_intersect(mentioned, known), F.array_intersect(targets, known)
    words = source_intent(prose)
    fallback = F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, ","))
    return F.when(F.size(own) > 0, own).when((intent == "QUERY") & (F.size(pages) > 0), pages).otherwise(fallback)


def interleaved(found: DataFrame, key: str, source: str, score: str, cap: int, most: int) -> DataFrame:
    """Adds rank to the first ``most`` rows when sources take turns: each one's best, the source with the best of all first, then each one's second, up to cap.

    Of each source only cap rows go on, so that the turns are taken among few rows.
    """
    own = Window.partitionBy(source).orderBy(F.desc(score), key)
    top = found.withColumn("_turn", F.row_number().over(own)).where(F.col("_turn") <= cap)
    lead = top.where("_turn = 1").select(source, F.col(score).alias("_lead"), F.col(key).alias("_first"))
    order = ["_turn", F.desc("_lead"), "_first"]
    picked = top.join(F.broadcast(lead), source).orderBy(*order).limit(most)  # a row for each source
    return picked.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_turn", "_lead", "_first")


def excerpts(docs: DataFrame, terms: list[str], most: int) -> DataFrame:
    """doc_id, excerpt: of each whole text the run of lines of at most ``most`` characters with the most hits of terms, the first of equal runs, after the heading if the text has one.

    A line hits once for each term in it; a line that is too long by itself stands alone, whole. Texts that fit come whole; without terms, or of one line, their beginning comes.
    Nulls count as empty. Runs are found from running sums of the lines' lengths and hits.
    """

    def best(text: str) -> str:
        clean = text.strip()
        if len(clean) <= most:
            return clean
        lines = [line for line in clean.split("\n") if line.strip()]
        if not terms or len(lines) <= 1:
            return clean[:most]
        title = lines[0].lstrip("#")
        heading = title.strip() if title != lines[0] and title[:1].isspace() else ""
        body = lines[1:] if heading else lines
        ends = np.cumsum([len(line) + 1 for line in body])
        hits = np.concatenate(([0], np.cumsum([sum(t in line.lower() for t in terms) for line in body])))
        starts = np.concatenate(([0], ends[:-1]))
        stops = np.maximum(np.searchsorted(ends, starts + most, side="right"), np.arange(1, len(body) + 1))
        first = int(np.argmax(hits[stops] - hits[:-1]))
        passage = ("… " if first else "") + " ".join(body[first : stops[first]])
        return f"{heading} — {passage}" if heading else passage

    @F.pandas_udf("string")
    def excerpt(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(best)

    return docs.select("doc_id", excerpt("text").alias("excerpt"))


def catalog_found(catalog: DataFrame, typed: str, most: int = 8) -> DataFrame:
    """The first entries (place, id, label) whose id or label holds what was typed after an @, all where nothing was."""
    words = typed.strip().lower().removeprefix("@")
    found = catalog.where(F.contains(F.lower("id"), F.lit(words)) | F.contains(F.lower("label"), F.lit(words)))
    return found.orderBy("place").limit(most)


def references(refs: Column, prose: Column) -> Column:
    """Struct of targets, model, context and the prose without labels, from an array of references (type, id, label); repeated ones count once."""
    once = F.array_distinct(refs)
    of = lambda kind: F.transform(F.filter(once, lambda r: r["type"] == kind), lambda r: r["id"])
    bare = F.aggregate(once, prose, lambda t, r: F.replace(t, r["label"], F.lit(" ")))
    return F.struct(of("page").alias("targets"), F.get(of("model"), 0).alias("model"), of("entity").alias("context"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("prose"))
