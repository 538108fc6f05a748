"""The training-data queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import alignment, ann, byte_bpe, exact_dedup, filter_audit, html_extract, licenses, near_dedup, packing, quality, token_store, toxicity, url_filter
from quillmere.llm.support import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files source/lang/doc_id: each source is a tree with a directory for each language."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("file_id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the doc_ids stands for the snapshot, the upper half for the batch."""
    docs = read(spark, sf_dir, "documents")
    return exact_dedup.deduplicate(docs, exact_dedup.lower_half(docs))


def op5_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


#: The rules that the query's contract fixes.
URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op7_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(read(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read(spark, sf_dir, "documents"))


def op11_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(read(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_license_scan, op2_toxicity, op3_best_fit_packing, op4_exact_dedup, op5_ivf_pq_search, op6_url_templates, op7_html_mincut, op8_byte_bpe,
        op9_minhash_near_dedup, op10_token_store, op11_subword_quality, op12_token_alignment, op13_filter_interactions,
    )
    return {f.__name__: f for f in every}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_sql_text(n)}, {_sql_text(t)}, {licenses.FILE_COSINE if whole else licenses.HEADER_COSINE})" for i, (n, t, whole) in enumerate(licenses.TEMPLATES))}) AS v(template, license, text, least)),
files AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, concat_ws('/', source, lang) AS dir, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS total FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{licenses.TERM}'))) AS term FROM files) GROUP BY term),
s_tf AS (SELECT template, license, least, term, count(*) AS tf FROM (SELECT template, license, least, unnest(regexp_extract_all(lower(text), '{licenses.TERM}')) AS term FROM templates) GROUP BY ALL),
s_w AS (SELECT template, license, least, term, tf * (ln((1.0 + total) / (1 + coalesce(df, 0))) + 1) AS w FROM s_tf LEFT JOIN df USING (term), n),
s AS (SELECT template, license, least, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM s_w),
parts AS (
  SELECT DISTINCT doc_id, dir, 'unit' AS part, unit FROM (SELECT doc_id, dir, unnest(list_concat(string_split(text, chr(10)), string_split_regex(regexp_replace(text, '{licenses.MARKS}', '', 'g'), '{licenses.BLANK}'))) AS unit FROM files)
  UNION ALL SELECT doc_id, dir, 'whole', text FROM files
),
tf AS (
  SELECT doc_id, dir, part, unit, term, count(*) AS tf
  FROM (SELECT *, unnest(regexp_extract_all(lower(unit), '{licenses.TERM}')) AS term FROM parts) GROUP BY ALL
),
w AS (SELECT tf.*, tf * (ln((1.0 + total) / (1 + coalesce(df, 0))) + 1) AS w FROM tf LEFT JOIN df USING (term), n),
norm AS (SELECT doc_id, part, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT doc_id, dir, part, unit, template, license, least, sum(w.w * s.w) AS dot FROM w JOIN s USING (term) GROUP BY ALL),
cosine AS (SELECT doc_id, dir, part, license, least, round(dot / norm, 6) AS score FROM dot JOIN norm USING (doc_id, part, unit)),
notice AS (
  SELECT doc_id, license AS own_license, score AS own_score FROM cosine WHERE part = 'unit' AND score >= {licenses.HEADER_COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
),
likest AS (
  SELECT doc_id, dir, license, score FROM cosine WHERE part = 'whole' AND score >= least
  QUALIFY row_number() OVER (PARTITION BY doc_id, dir ORDER BY score DESC, license) = 1
),
file_like AS (SELECT doc_id, dir, score, CASE WHEN score >= {licenses.VERBATIM} THEN license ELSE coalesce(own_license, license) END AS license FROM likest LEFT JOIN notice USING (doc_id)),
verbatim AS (SELECT doc_id, license, score FROM likest WHERE score >= {licenses.VERBATIM} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, coalesce(license, own_license) AS own_license, coalesce(score, own_score) AS own_score FROM notice FULL JOIN verbatim USING (doc_id)),
by_dir AS (SELECT dir AS above, license AS dir_license FROM file_like QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
dirs AS (SELECT DISTINCT dir FROM files),
near AS (
  SELECT dir, above, dir_license FROM dirs JOIN by_dir ON dir = above OR above = '' OR starts_with(dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1
),
best AS (SELECT doc_id, max(score) AS file_license_score FROM file_like GROUP BY doc_id)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, dir_license) AS license,
       CASE WHEN own_license IS NULL THEN above END AS inherited_from, file_license_score
FROM files LEFT JOIN near USING (dir) LEFT JOIN own USING (doc_id) LEFT JOIN best USING (doc_id)
"""


OP4_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


OP13_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
),
f AS (
  SELECT doc_id, part, [
    len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS fails
  FROM t
),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT '' AS filter_order, []::INT[] AS ks
  UNION ALL SELECT filter_order || letter, list_append(ks, k) FROM orders, letters WHERE NOT list_contains(ks, k)
),
full_orders AS (SELECT * FROM orders WHERE len(ks) = 5),
s AS (SELECT filter_order, step, ks[step] AS k, ks[1 : step - 1] AS earlier FROM full_orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
sets AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY ALL),
w AS (SELECT *, fails[k] AS bad, list_bool_or(list_transform(list_append(earlier, 6), lambda e: coalesce(fails[e], false))) AS gone FROM sets, s),
r AS (
  SELECT part, filter_order, step, k, coalesce(sum(docs) FILTER (WHERE NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(docs) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(docs) FILTER (WHERE bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(docs) FILTER (WHERE bad AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM w GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op13_filter_interactions": OP13_SQL}
