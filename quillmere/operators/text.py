"""Text operators: cleaning, tokens, BM25, shingles, near duplicates, secrets, chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmere.operators import graph
from quillmere.sources import staging

#: Fixed values of the text rules.
OCR_REPAIRS = (
    (r"\b0([A-Za-z])", "O$1"), (r"([A-Za-z])0\b", "$1O"), (r"\bl\b", "I"), (r"\brn\b", "m"), (r"(\w)rn(\w)", "$1m$2"), (r"\bvv\b", "w"),
    (r"(\w)vv(\w)", "$1w$2"), (r"\|", "I"), (r"(?<=[a-z])1(?=[a-z])", "l"), (r"(?<=[A-Z])1(?=[A-Z])", "I"), (r"(?<=\d),(?=\d{3})", ""),
)
SECRET_LINE = r"(?i)(password|passwd|api[_\-]?key|secret|token|private[_\-]?key|auth[_\-]?token|access[_\-]?key|client[_\-]?secret)\s*[:=]\s*\S+"
BEARER = r"(?i)Bearer\s+[A-Za-z0-9\-_\.]{10,}"
CPI = {1950: 5.7, 1960: 7.5, 1970: 10.4, 1980: 29.0, 1990: 53.4, 2000: 72.8, 2010: 92.4, 2015: 100.0, 2020: 108.9, 2024: 128.3}
K1, B = 1.5, 0.75
CHUNK_CHARS, OVERLAP_CHARS, LEAST_CHARS = 2048, 409, 64
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


# --- cleaning ---------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which no built-in function gives."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def surface_clean(text: Column) -> Column:
    """Control characters become spaces, soft hyphens go, runs of blanks and of empty lines shrink, the ends are trimmed."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    text = F.regexp_replace(text, "­", "")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def ocr_repair(text: Column) -> Column:
    """Undoes common confusions of optical character recognition; harms clean text, so it is for scanned sources only."""
    for pattern, replacement in OCR_REPAIRS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def iso_dates(text: Column) -> Column:
    """Day/month/year with a plausible day and month becomes year-month-day."""
    return F.regexp_replace(text, r"\b(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/((?:19|20)\d\d)\b", "$3-$2-$1")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


# --- tokens and BM25 --------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters a to z; what other letters or digits touch isn't one."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{2,}$"))


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str]) -> DataFrame:
    """doc_id and score of documents for the query's terms. Lengths and frequencies are those of all documents.

    The query's terms are the only ones that are counted and shuffled.
    """
    listed = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.filter("t", lambda w: w.isin(*query)).alias("t"))
    stats = listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    tf = listed.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row for each term of the query; one row
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avg_dl", F.lit(1.0))))
    return joined.groupBy("doc_id").agg(F.sum(part).alias("score"))


# --- shingles and near duplicates -------------------------------------------------------------------------------


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct k-word shingles; a shorter text is its own."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # Zipped with itself shifted: a lambda that indexed the whole array would extract the words again for each of them.
    many = words
    for i in range(1, k):
        many = F.zip_with(many, F.slice(words, i + 1, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    many = F.array_distinct(F.filter(many, lambda s: s.isNotNull()))
    return F.when(F.size(words) >= k, many).otherwise(F.array(F.array_join(words, " ")))


def shingle_hash(shingle: Column) -> Column:
    """31 bits of the MD5, which other engines compute as well."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long") % 2147483647


def permutations(n: int = 128) -> list[tuple[int, int]]:
    """Multipliers and addends of n hash functions modulo 2^31 - 1, by a linear congruence from 42."""
    out, x = [], 42
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % 2147483648
            pair.append(x % 2147483646 + 1)
        out.append(tuple(pair))
    return out


def minhash(hashes: DataFrame, n: int = 128, *carried: str) -> DataFrame:
    """doc_id, signature and the carried columns from doc_id and h (array of 31-bit shingle hashes)."""
    import numpy as np

    pairs = permutations(n)

    @F.pandas_udf("array<long>")
    def sign(h: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, b = (np.array(x, np.int64)[:, None] for x in zip(*pairs))
        prime = 2147483647

        def least(x: np.ndarray) -> np.ndarray:
            y = a * np.asarray(x, np.int64) + b
            y = (y & prime) + (y >> 31)  # modulo 2^31 - 1 by folding, which divides nothing
            y = (y & prime) + (y >> 31)
            y[y == prime] = 0
            return y.min(axis=1)

        for some in h:
            yield pd.Series([least(x) for x in some])

    return hashes.select("doc_id", sign("h").alias("signature"), *carried)


def lsh_buckets(signatures: DataFrame, bands: int = 16, rows: int = 8) -> DataFrame:
    """doc_id, band, bucket: 16 bands of 8 rows meet pairs of Jaccard similarity .85 with a probability of .994."""
    parts = F.array(*(F.substring(F.sha2(F.array_join(F.slice("signature", i * rows + 1, rows), "|"), 256), 1, 16) for i in range(bands)))
    return signatures.select("doc_id", F.posexplode(parts).alias("band", "bucket"))


#: Members on each side of one block of comparisons.
BLOCK = 512


def near_duplicates(docs: DataFrame, threshold: float = 0.85, bands: int = 16, rows: int = 8) -> DataFrame:
    """doc_id and canonical, the smallest document of its class: links lead between documents that share a bucket and are similar enough.

    The similarity is that of the whole shingle sets, kept as 64-bit hashes. Documents of the same text are one entry, under the smallest. Entries are
    compared with the first of their buckets; then, in buckets whose members aren't all of one class by now, each member outside the bucket's largest class is
    compared with all others of other classes, in blocks. So a group of copies costs its size, and no link is left out that could join two classes.
    """
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("key"))
    entries = staging.written(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "entries")
    shingled = docs.select("doc_id", shingles(F.col("text")).alias("s")).select("doc_id", F.transform("s", shingle_hash).alias("h"), F.transform("s", lambda x: F.xxhash64(x)).alias("set"))
    signed = minhash(shingled, bands * rows, "set").join(entries.select("doc_id"), "doc_id")
    # Signatures end here: of each entry the buckets and the set are written, and the set's size goes with its buckets.
    bucket_of = [F.xxhash64(F.lit(i), F.substring(F.sha2(F.array_join(F.slice("signature", i * rows + 1, rows), "|"), 256), 1, 16)) for i in range(bands)]
    hashed = staging.written(signed.select("doc_id", "set", F.size("set").alias("size"), F.array(*bucket_of).alias("buckets")), "hashed")
    buckets = hashed.select("doc_id", "size", F.explode("buckets").alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by(F.struct("doc_id", "size"), "doc_id").alias("first")).where("n > 1")
    members = staging.written(buckets.join(several, "bucket").select("bucket", "doc_id", "size", "n", F.col("first.doc_id").alias("first"), F.col("first.size").alias("first_size")), "members")
    # Sets of entries that share no bucket are read by nothing.
    wanted = members.select("doc_id").distinct()
    sets = staging.written(hashed.select("doc_id", "set").join(wanted, "doc_id", "left_semi"), "sets")
    staging.discard(hashed)

    def near(a: str, b: str) -> Column:
        """Whether sets of these sizes can be similar enough; those that can't aren't joined to the pair."""
        return F.least(a, b) >= threshold * F.greatest(a, b)

    def linked(pairs: DataFrame) -> DataFrame:
        u, v = sets.select(F.col("doc_id").alias("u"), F.col("set").alias("s")), sets.select(F.col("doc_id").alias("v"), F.col("set").alias("s2"))
        common = F.size(F.array_intersect("s", "s2"))
        return pairs.join(u, "u").join(v, "v").where(common >= threshold * (F.size("s") + F.size("s2") - common)).select("u", "v")

    first = linked(members.where("doc_id <> first").where(near("size", "first_size")).select(F.col("doc_id").alias("u"), F.col("first").alias("v")).distinct())
    links = staging.written(first, "links")
    labels = graph.components(links).withColumnRenamed("node", "doc_id")
    own = members.join(labels, "doc_id", "left").select("bucket", "doc_id", "size", F.coalesce("label", "doc_id").alias("label"))
    own = staging.written(own, "labelled")
    sizes = own.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    own = own.join(mixed, "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block, every = F.pmod(F.xxhash64("doc_id"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    minor = own.where("label <> most").select("bucket", F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("size").alias("sa"), block.alias("x"), F.explode(every).alias("y"))
    others = own.select("bucket", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.explode(every).alias("x"), block.alias("y"))
    rest = minor.join(others, ["bucket", "x", "y"]).where("la <> lb").where(near("sa", "sb")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    classes = graph.components(links.unionByName(linked(rest))).withColumnRenamed("node", "doc_id")
    found = entries.join(classes, "doc_id", "left").select("key", F.coalesce("label", "doc_id").alias("canonical"))
    return keyed.join(found, keyed.key.eqNullSafe(found.key)).select("doc_id", "canonical")


# --- secrets ----------------------------------------------------------------------------------------------------


def stable_token(kind: Column, value: Column) -> Column:
    """KIND_ and six digits, the same for the same value everywhere."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", kind, value), 256), 1, 8), 16, 10).cast("long")
    return F.concat(kind, F.lit("_"), F.lpad((digest % 1000000).cast("string"), 6, "0"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, kind, value, token of each distinct secret in a text."""
    found = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(SECRET_LINE), F.lit(0)), lambda v: F.struct(F.lit("SECRET_VALUE").alias("kind"), v.alias("value"))),
        F.transform(F.regexp_extract_all("text", F.lit(BEARER), F.lit(0)), lambda v: F.struct(F.lit("API_KEY").alias("kind"), v.alias("value"))),
    )
    return docs.select("doc_id", F.explode(F.array_distinct(found)).alias("f")).select("doc_id", "f.kind", "f.value", stable_token(F.col("f.kind"), F.col("f.value")).alias("token"))


def masked(text: Column) -> Column:
    """Secrets replaced by their kind; whole lines first."""
    return F.regexp_replace(F.regexp_replace(text, SECRET_LINE, "[SECRET_VALUE]"), BEARER, "[API_KEY]")


def merged_spans(spans: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, score: overlapping spans joined; the highest score names them, of equal ones the later."""
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("score"), "end", "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order)).withColumn("_place", F.row_number().over(order))
    best = F.max_by(F.struct("kind", "score"), F.struct("score", "_place"))
    return islands.groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b")).select("doc_id", "start", "end", "b.kind", "b.score")


# --- chunks -----------------------------------------------------------------------------------------------------


def split_text(text: str, limit: int = CHUNK_CHARS, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` characters that joined give the text again: cut at the coarsest separator that is there, which stays with the piece before it."""
    if len(text) <= limit:
        return [text] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    parts = text.split(separators[at])
    parts = [p + separators[at] for p in parts[:-1]] + parts[-1:]
    out: list[str] = []
    held = ""
    for part in parts:
        if len(held) + len(part) <= limit:
            held += part
            continue
        if held:
            out.append(held)
        if len(part) <= limit:
            held = part
        else:
            out += split_text(part, limit, separators[at + 1 :])
            held = ""
    return [p for p in [*out, held] if p.strip()]


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_index, segment: the text split, with short segments joined to the next."""

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[str]:
            out: list[str] = []
            held = ""
            for piece in split_text(t or ""):
                held += piece
                if len(held.strip()) >= LEAST_CHARS:
                    out.append(held)
                    held = ""
            if held.strip():
                if out:
                    out[-1] += held
                else:
                    out.append(held)
            return out

        return text.map(of)

    return docs.select("doc_id", F.posexplode(split("text")).alias("chunk_index", "segment"))


def chunks(docs: DataFrame) -> DataFrame:
    """chunk_id, doc_id, chunk_index, total_chunks, text, char_start, word_count; each chunk but the first begins with its predecessor's end."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    tail = F.lag(F.right("segment", F.lit(OVERLAP_CHARS))).over(order)
    start = F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = segments(docs).select(
        "doc_id", "chunk_index", F.count("*").over(Window.partitionBy("doc_id")).alias("total_chunks"),
        F.concat(F.coalesce(F.concat(tail, F.lit("\n...\n")), F.lit("")), "segment").alias("text"), start.alias("char_start"),
    )
    return found.withColumn("word_count", word_count(F.col("text"))).withColumn("chunk_id", uuid5_url(F.concat_ws(":", "doc_id", "chunk_index")))


def uuid5_url(name: Column) -> Column:
    """UUID version 5 of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def extraction_windows(text: Column, short: int = 200, size: int = 12000, overlap: int = 600, most: int = 10) -> Column:
    """Windows of a text for extraction: none if it is short, one up to ``size``, else at most ``most`` that overlap and cover it."""
    n = F.length(text)
    width = F.greatest(F.lit(size), F.ceil(n / most) + overlap).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), width - overlap)
    return F.when(n < short, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, width)))


# --- estimates, tokens resolved, dates ---------------------------------------------------------------------------


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Struct of estimate and sigma from two signatures of one length: the share of equal values, and its standard error."""
    share = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)
    return F.struct(share.alias("estimate"), F.sqrt(share * (1 - share) / F.size(a)).alias("sigma"))


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, text with each secret as its token in brackets, and tokens: the map from token to value that resolved() takes.

    Longer values are replaced first, so that one inside another can't break it.
    """
    found = secrets(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value", "token")), False).alias("_found"))
    put = F.aggregate("_found", F.col("text"), lambda t, f: F.replace(t, f["value"], F.concat(F.lit("["), f["token"], F.lit("]"))))
    tokens = F.map_from_entries(F.transform(F.array_distinct(F.transform("_found", lambda f: f["token"])), lambda t: F.struct(t, F.filter("_found", lambda f: f["token"] == t)[0]["value"])))
    own = docs.join(found, "doc_id", "left")
    return own.select("doc_id", F.when(F.col("_found").isNull(), F.col("text")).otherwise(put).alias("text"), F.coalesce(tokens, F.create_map().cast("map<string,string>")).alias("tokens"))


def resolved(text: Column, tokens: Column) -> Column:
    """The text with the values of its tokens in their places again."""
    return F.aggregate(F.map_entries(tokens), text, lambda t, e: F.replace(t, F.concat(F.lit("["), e["key"], F.lit("]")), e["value"]))


def full_year(yy: Column) -> Column:
    """Years of two digits: from 50 on in the last century, before that in this one."""
    return F.when(yy >= 50, yy + 1900).otherwise(yy + 2000)


def parsed_date(text: Column, era: Column | int = 2000, first: int = 1900, last: int = 2030) -> Column:
    """The date that a string is, in numbers or with the month's English name; null for others and for years outside first to last.

    Numbers are month, day and year, or day, month and year in documents of an era before 1990 and where the first can't be a month.
    """
    own = F.trim(text)
    digits = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})$"
    part = lambda i: F.regexp_extract(own, digits, i).try_cast("int")
    year = F.when(part(3) < 100, full_year(part(3))).otherwise(part(3))
    era = F.lit(era) if isinstance(era, int) else era
    day_first = (era < 1990) & (part(2) <= 12) | (part(1) > 12)
    month, day = F.when(day_first, part(2)).otherwise(part(1)), F.when(day_first, part(1)).otherwise(part(2))
    iso = F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")
    named = F.regexp_replace(F.regexp_replace(own, r"(?<=\d)(st|nd|rd|th)\b", ""), ",", "")
    tried = [F.try_to_timestamp(named, F.lit(f)).cast("date") for f in ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")]
    found = F.when(own.rlike(digits), iso).when(own.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(own, F.lit(10)).try_cast("date")).otherwise(F.coalesce(*tried))
    return F.when(F.year(found).between(first, last), found)


def repaired(text: Column) -> Column:
    """Characters of Windows-1252 that were read as control characters, as the ones that they stand for; the five that it lacks stay."""
    codes = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    return F.translate(text, "".join(map(chr, codes)), bytes(codes).decode("cp1252"))


def decoded(raw: Column, western: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Windows-1252 for sources that are western, else UTF-8 with replacements."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).when(western, repaired(F.decode(raw, "ISO-8859-1"))).otherwise(F.make_valid_utf8(raw.cast("string")))
