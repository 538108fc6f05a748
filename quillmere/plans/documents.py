"""Queries on documents: tokens, ranking statistics, duplicates, secrets, chunks, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import text
from quillmere.plans.registry import query
from quillmere.sources import tables

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_TOKENS = rf"list_filter({_WORDS}, lambda w: regexp_full_match(w, '[a-z]{{2,}}'))"
_TERMS = ("the", "and", "de", "para", "erer", "than", "ist")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


_BM25_SQL = f"""WITH l AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avg_dl FROM l),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM l) WHERE term IN {_TERMS} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avg_dl, 1)))) AS score FROM tf JOIN df USING (term), s GROUP BY doc_id)"""


@query(f"{_BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.bm25(_docs(spark, sf_dir), list(_TERMS)).withColumn("score", F.round("score", 6))


@query(f"{_BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.bm25(_docs(spark, sf_dir), list(_TERMS)).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL), d AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term)
SELECT term, df, cf, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d"""
)
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    df = text.term_counts(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


_SHINGLES = f"CASE WHEN len({_WORDS}) >= 3 THEN list_distinct(list_transform(generate_series(1, len({_WORDS}) - 2), lambda i: array_to_string(list_slice({_WORDS}, i, i + 2), ' '))) ELSE [array_to_string({_WORDS}, ' ')] END"
_SHINGLES_SQL = f"w AS (SELECT doc_id, {_WORDS} AS w FROM documents), sh AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) ELSE [array_to_string(w, ' ')] END AS s FROM w)"


@query(f"WITH {_SHINGLES_SQL} SELECT doc_id, len(s) AS n_shingles FROM sh")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(text.shingles(F.col("text"))).cast("long").alias("n_shingles"))


_HASH = "CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 2147483647"
_MINHASH_SQL = f"""{_SHINGLES_SQL}, h AS (SELECT doc_id, list_transform(s, lambda x: {_HASH}) AS h FROM sh),
p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(text.permutations(128)))}) AS v(i, a, b)),
m AS (SELECT doc_id, i, min((x * a + b) % 2147483647) AS v FROM (SELECT doc_id, unnest(h) AS x FROM h), p GROUP BY ALL),
sig AS (SELECT doc_id, list(v ORDER BY i) AS signature FROM m GROUP BY doc_id)"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", F.transform(text.shingles(F.col("text")), text.shingle_hash).alias("h"))
    return text.minhash(own, 128)


@query(f"WITH {_MINHASH_SQL} SELECT doc_id, signature[1] AS v1, signature[128] AS v128, md5(array_to_string(signature, '|')) AS digest FROM sig")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _signatures(spark, sf_dir)
    return found.select("doc_id", F.element_at("signature", 1).alias("v1"), F.element_at("signature", 128).alias("v128"), F.md5(F.array_join("signature", "|")).alias("digest"))


_BUCKETS_SQL = f"{_MINHASH_SQL}, bk AS (SELECT doc_id, k - 1 AS band, substr(sha256(array_to_string(list_slice(signature, (k - 1) * 8 + 1, k * 8), '|')), 1, 16) AS bucket FROM sig, generate_series(1, 16) AS g(k))"


@query(f"WITH {_BUCKETS_SQL} SELECT band, bucket, count(*) AS n, min(doc_id) AS first FROM bk GROUP BY ALL HAVING count(*) > 1")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that several documents share."""
    found = text.lsh_buckets(_signatures(spark, sf_dir)).groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return found.where("n > 1").withColumn("band", F.col("band").cast("long"))


@query(
    f"""WITH RECURSIVE {_BUCKETS_SQL}, pr AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM bk a JOIN bk b ON a.band = b.band AND a.bucket = b.bucket AND a.doc_id > b.doc_id),
j AS (SELECT u, v, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS la, len(b.s) AS lb FROM pr JOIN sh a ON u = a.doc_id JOIN sh b ON v = b.doc_id),
li AS (SELECT u, v FROM j WHERE c >= 0.85 * (la + lb - c)), e AS (SELECT u AS a, v AS b FROM li UNION ALL SELECT v, u FROM li),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS canonical FROM documents d LEFT JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id) USING (doc_id)"""
)
def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.near_duplicates(_docs(spark, sf_dir))


@query("SELECT source AS tenant, sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).groupBy(F.col("source").alias("tenant"), F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return found.where("copies > 1")


_SECRET = text.SECRET_LINE
_BEARER = text.BEARER
_LINES_SQL = "t AS (SELECT doc_id, text || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'api_key: k' || doc_id WHEN 1 THEN 'Authorization Bearer abcdefghij' || doc_id ELSE 'nothing here' END AS text FROM documents)"


def _with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a made-up secret at the end of two in three, as none has a credential line of its own."""
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("api_key: k"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Authorization Bearer abcdefghij"), "doc_id")).otherwise("nothing here")
    return _docs(spark, sf_dir).select("doc_id", F.concat_ws("\n", "text", line).alias("text"))


@query(f"WITH {_LINES_SQL} SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_SECRET}', '[SECRET_VALUE]', 'g'), '{_BEARER}', '[API_KEY]', 'g')) AS digest FROM t")
def pii_secret_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_secrets(spark, sf_dir).select("doc_id", F.md5(text.masked(F.col("text"))).alias("digest"))


@query(
    f"""WITH {_LINES_SQL}, f AS (SELECT DISTINCT doc_id, 'SECRET_VALUE' AS kind, unnest(regexp_extract_all(text, '{_SECRET}')) AS value FROM t UNION SELECT doc_id, 'API_KEY', unnest(regexp_extract_all(text, '{_BEARER}')) FROM t)
SELECT doc_id, kind, value, kind || '_' || lpad(CAST(CAST(('0x' || substr(sha256(kind || '|' || value), 1, 8)) AS BIGINT) % 1000000 AS VARCHAR), 6, '0') AS token FROM f"""
)
def pii_stable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.secrets(_with_secrets(spark, sf_dir))


@query(f"WITH {_LINES_SQL} SELECT kind, count(*) AS n FROM (SELECT DISTINCT doc_id, 'SECRET_VALUE' AS kind, unnest(regexp_extract_all(text, '{_SECRET}')) AS v FROM t UNION SELECT doc_id, 'API_KEY', unnest(regexp_extract_all(text, '{_BEARER}')) FROM t) GROUP BY kind")
def pii_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.secrets(_with_secrets(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


_SPANS_SQL = "sp AS (SELECT l_orderkey AS doc_id, l_partkey % 200 AS start, l_partkey % 200 + 1 + l_suppkey % 30 AS \"end\", p_brand AS kind, CAST(l_quantity AS BIGINT) AS score FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(
    f"""WITH {_SPANS_SQL}, o AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc_id ORDER BY start, score DESC, "end", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh,
  row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC, "end", kind) AS place FROM sp),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM o)
SELECT doc_id, min(start) AS start, max("end") AS "end", arg_max(kind, score * 1000 + place) AS kind, max(score) AS score FROM i GROUP BY doc_id, island"""
)
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for detected spans."""
    items = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    start = F.col("l_partkey") % 200
    return text.merged_spans(items.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 1 + F.col("l_suppkey") % 30).alias("end"), F.col("p_brand").alias("kind"), F.col("l_quantity").cast("long").alias("score")))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), chr(173), ''), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM (SELECT doc_id, replace(text, '. ', '.' || chr(9) || ' ' || chr(7)) AS text FROM documents)")
def surface_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with tabs and bells put in."""
    noisy = _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\t \x07")).alias("text"))
    return noisy.select("doc_id", F.md5(text.surface_clean(F.col("text"))).alias("digest"))


@query()
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No oracle: the rules look around, which the checking engine's expressions can't. Tested on literal cases."""
    return _docs(spark, sf_dir).select("doc_id", F.length(text.ocr_repair(F.col("text"))).alias("n"), F.md5(text.ocr_repair(F.col("text"))).alias("digest"))


_DATES_SQL = "'seen ' || (doc_id % 35) || '/' || (doc_id % 14) || '/' || (1985 + doc_id % 40) || ', v1.2.34'"


@query(rf"SELECT doc_id, length(text) AS n, md5(text) AS digest FROM (SELECT doc_id, regexp_replace({_DATES_SQL} || ' ' || text || chr(10) || {_DATES_SQL}, '\b(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/((?:19|20)\d\d)\b', '\3-\2-\1', 'g') AS text FROM documents)")
def date_rewrite_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts between dates of which some are none."""
    made = F.concat(F.lit("seen "), F.col("doc_id") % 35, F.lit("/"), F.col("doc_id") % 14, F.lit("/"), F.col("doc_id") % 40 + 1985, F.lit(", v1.2.34"))
    whole = _docs(spark, sf_dir).select("doc_id", text.iso_dates(F.concat(made, F.lit(" "), "text", F.lit("\n"), made)).alias("text"))
    return whole.select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("SELECT doc_id, sha256(text) AS content_hash, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count, length(text) AS n FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"), text.word_count(F.col("text")).cast("long").alias("word_count"), F.length("text").cast("long").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links")
    )


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No oracle: the splitter is recursive. Tests hold it to its limits and to covering the text."""
    return text.chunks(_docs(spark, sf_dir).select("doc_id", "text"))


@query("SELECT doc_id, count(*) AS windows, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(CASE WHEN length(text) < 200 THEN [] WHEN length(text) <= 12000 THEN [length(text)] ELSE list_transform(generate_series(0, length(text) - 601, greatest(12000, CAST(ceil(length(text) / 10) AS BIGINT) + 600) - 600), lambda s: least(greatest(12000, CAST(ceil(length(text) / 10) AS BIGINT) + 600), length(text) - s)) END) AS n FROM documents) GROUP BY doc_id")
def extraction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _docs(spark, sf_dir).select("doc_id", F.explode(text.extraction_windows(F.col("text"))).alias("w"))
    return windows.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.length("w")).alias("chars"))


@query(
    f"""WITH c(year, cpi) AS (VALUES {", ".join(f"({y}, {v})" for y, v in text.CPI.items())}), y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
n AS (SELECT y, arg_min(cpi, abs(year - y) * 10000 + year) AS cpi FROM y, c GROUP BY y)
SELECT o_orderkey, round(o_totalprice * 128.3 / cpi, 4) AS adjusted FROM orders JOIN n ON year(o_orderdate) = y"""
)
def cpi_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in 2024 money, by the nearest year that has an index; of two equally near, the earlier."""
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    index = spark.createDataFrame(list(text.CPI.items()), "year int, cpi double")
    near = orders.select("y").distinct().crossJoin(F.broadcast(index)).groupBy("y").agg(F.min_by("cpi", F.struct(F.abs(F.col("year") - F.col("y")), "year")).alias("cpi"))
    return orders.join(F.broadcast(near), "y").select("o_orderkey", F.round(F.col("o_totalprice") * 128.3 / F.col("cpi"), 4).alias("adjusted"))


@query(
    """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) AS z, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS unit
FROM customer WINDOW w AS (PARTITION BY c_mktsegment)"""
)
def zscore_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard scores and unit range of each segment; without spread 0 and one half."""
    customers = tables.table(spark, sf_dir, "customer")
    stats = customers.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"), F.min("c_acctbal").alias("a"), F.max("c_acctbal").alias("b"))
    z = F.when(F.col("s") < 1e-10, 0.0).otherwise((F.col("c_acctbal") - F.col("m")) / F.col("s"))
    unit = F.when(F.col("b") - F.col("a") < 1e-10, 0.5).otherwise((F.col("c_acctbal") - F.col("a")) / (F.col("b") - F.col("a")))
    return customers.join(stats, "c_mktsegment").select("c_custkey", F.round(z, 6).alias("z"), F.round(unit, 6).alias("unit"))


@query("SELECT lang || ':' || source AS namespace, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY 1")
def namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).groupBy(F.concat_ws(":", "lang", "source").alias("namespace"))
    return found.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))




_DATES = ("yyyy-MM-dd", "M/d/yyyy", "MM-dd-yy", "d MMMM yyyy", "MMM d, yyyy", "M.d.yyyy")


@query(
    """SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderdate END) AS INTEGER) AS epoch_days,
CASE WHEN o_orderkey % 7 < 6 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) WHEN o_orderkey % 7 < 6 THEN CAST(o_orderdate AS DATE) END AS day_first FROM orders"""
)
def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders written in six ways, and beyond the years that count; and as documents of the eighties write numbers."""
    way = F.col("o_orderkey") % 7
    known = [F.when(way == i, F.date_format("o_orderdate", f)) for i, f in enumerate(_DATES)]
    written = F.coalesce(*known, F.concat(F.lit("2031-"), F.date_format("o_orderdate", "MM-dd")))
    numbers = F.when(way < 6, F.date_format("o_orderdate", "M/d/yyyy"))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(text.parsed_date(written)).alias("epoch_days"), text.parsed_date(numbers, 1985).alias("day_first"))


@query(f"WITH {_LINES_SQL} SELECT doc_id, sha256(text) AS digest, regexp_matches(text, '{_SECRET}') OR regexp_matches(text, '{_BEARER}') AS hidden FROM t")
def tokens_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets as tokens and back: the texts as they were, and whether each secret was away in between."""
    docs = _with_secrets(spark, sf_dir)
    found = text.tokenised(docs)
    gone = (F.size("tokens") > 0) & F.forall(F.map_values("tokens"), lambda v: ~F.contains(F.col("text"), v))
    return found.select("doc_id", F.sha2(text.resolved(F.col("text"), F.col("tokens")), 256).alias("digest"), gone.alias("hidden"))


@query(
    f"""WITH {_MINHASH_SQL}, a AS (SELECT s.doc_id, s.signature AS x, t.signature AS y FROM sig s JOIN sig t ON s.doc_id // 2 * 2 + 1 = t.doc_id), j AS (SELECT doc_id, len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) / 128 AS estimate FROM a)
SELECT doc_id, estimate, round(sqrt(estimate * (1 - estimate) / 128), 9) AS sigma FROM j"""
)
def signature_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next odd one, by their signatures."""
    odd = F.expr("doc_id div 2 * 2 + 1")
    own = _signatures(spark, sf_dir).select("doc_id", F.col("signature").cast("array<int>").alias("signature"), odd.alias("pair"))
    # The two of a pair meet in one group, so that signatures are computed once.
    pairs = own.groupBy("pair").agg(F.collect_list(F.struct("doc_id", "signature")).alias("of"))
    found = pairs.select("of", F.explode(F.filter("of", lambda x: x["doc_id"] == F.col("pair"))).alias("other")).select(F.explode("of").alias("own"), F.col("other.signature").alias("_other"))
    found = found.select("own.doc_id", text.jaccard_estimate(F.col("own.signature"), F.col("_other")).alias("j"))
    return found.select("doc_id", "j.estimate", F.round("j.sigma", 9).alias("sigma"))


@query("SELECT doc_id, sha256(text || ' “–”') AS digest FROM documents")
def bytes_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with typographic marks that were read as control characters, from bytes and repaired."""
    broken = F.concat("text", F.lit(" \x93\x96\x94"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.repaired(text.decoded(F.encode(broken, "UTF-8"), F.lit(False))), 256).alias("digest"))
