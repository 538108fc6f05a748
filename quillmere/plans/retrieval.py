"""Queries on vectors, chunks and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import strings
from quillmere.operators import retrieval
from quillmere.plans.registry import query
from quillmere.sources import tables

_PROMPTS_SQL = f"{tables.PROMPTS_SQL.replace('prompts AS', 'p0 AS', 1)}, prompts AS (SELECT conv_id, turn, prose, turn % 2 = 0 AS target FROM p0)"
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_ASKED = ["erer", "thereonth", "the", "thaner"]


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as prompts; every second one names a page."""
    return tables.prompts(spark, sf_dir).withColumn("target", F.col("turn") % 2 == 0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").withColumn("source", F.col("label"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.scored(vectors, vectors.where("vec_id = 0")).withColumn("score", F.round("score", 6))


_SCORES_SQL = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
sc AS (SELECT vec_id, label AS source, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q)"""


@query(f"WITH {_SCORES_SQL} SELECT vec_id, source, score FROM sc ORDER BY score DESC, vec_id LIMIT 15")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_scores(spark, sf_dir), 15)


@query(f"WITH {_SCORES_SQL} SELECT vec_id, source, score FROM sc WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 60")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_scores(spark, sf_dir), 60, 0.2)


@query(f"WITH {_SCORES_SQL} SELECT vec_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS rank FROM sc QUALIFY rank <= 5")
def knn_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_per_source(_scores(spark, sf_dir), 5)


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first, round(CAST(embedding[64] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS last FROM embeddings")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = retrieval.l2_normalised(F.col("embedding"))
    found = _vectors(spark, sf_dir).select("vec_id", v.alias("v"))
    return found.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"))


_CHUNKS_SQL = f"""{_SCORES_SQL}, ch AS (SELECT vec_id // 4 AS doc, vec_id % 4 AS chunk_index, 'src' || (sc.vec_id // 4) % 6 AS source, score, text FROM sc JOIN documents ON doc_id = vec_id),
d1 AS (SELECT doc, trim(text, ' ') AS t, min(chunk_index) AS i, max(score) AS s, arg_min(source, chunk_index) AS source FROM ch GROUP BY ALL),
g AS (SELECT doc, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text, max(s) AS best_score, arg_min(source, i) AS source, arg_max(i, s * 1000000 - i * 0.01) AS best_chunk, count(*) AS chunks FROM d1 GROUP BY doc)"""


def _regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are chunks, four a document, with the text of the document that has the vector's id."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    doc = F.expr("vec_id div 4")
    chunks = _scores(spark, sf_dir).drop("source").join(docs, "vec_id").select(doc.alias("doc"), (F.col("vec_id") % 4).alias("chunk_index"), F.concat(F.lit("src"), doc % 6).alias("source"), "score", "text")
    return retrieval.regrouped(chunks)


@query(f"WITH {_CHUNKS_SQL} SELECT doc, md5(text) AS digest, best_score, source, best_chunk, chunks FROM g")
def regroup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regrouped(spark, sf_dir).select("doc", F.md5("text").alias("digest"), "best_score", "source", "best_chunk", "chunks")


_HEADING = r"""(CASE WHEN regexp_matches(l, '^#+\s') THEN trim(regexp_replace(l, '^#+\s*', '')) WHEN length(l) <= 80 AND NOT regexp_matches(l, '\.\s') THEN l ELSE '' END)"""
_BOOST_SQL = f"""ln AS (SELECT doc_id, text, trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')) AS l FROM {{source}}),
hd AS (SELECT doc_id, lower(text) AS body, list_filter(regexp_split_to_array(lower({_HEADING}), '[^a-z0-9]+'), lambda x: x <> '') AS tk FROM ln),
bo AS (SELECT doc_id, ({" + ".join(f"CASE WHEN list_contains(tk, '{t}')" + (f" OR len(list_filter(tk, lambda x: length(x) >= 6 AND levenshtein(x, '{t}') <= 1)) > 0" if len(t) >= 6 else "") + f" THEN 0.5 WHEN contains(body, '{t}') THEN 0.1 ELSE 0 END" for t in _ASKED)}) / {len(_ASKED)} AS boost FROM hd)"""


@query(f"WITH {_BOOST_SQL.format(source='documents')} SELECT doc_id, round(boost, 6) AS boost FROM bo")
def lexical_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.round(retrieval.lexical_boost(_ASKED, F.col("text")), 6).alias("boost"))


@query(
    f"""WITH {_CHUNKS_SQL}, src AS (SELECT doc AS doc_id, text FROM g), {_BOOST_SQL.format(source='src')},
r AS (SELECT doc, g.source, left(trim(g.text, ' '), 400) AS head, round(best_score + boost, 6) AS rank_score FROM g JOIN bo ON doc = doc_id),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY head ORDER BY rank_score DESC, doc) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, doc) AS place FROM o)
SELECT doc, source, rank_score FROM p WHERE place <= CASE WHEN source = 'src1' THEN 2 ELSE 5 END ORDER BY rank_score DESC, doc LIMIT 12"""
)
def rank_documents_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.ranked(_regrouped(spark, sf_dir), _ASKED, 5, 12, {"src1": 2})
    return found.select("doc", "source", F.round("rank_score", 6).alias("rank_score"))


@query(f"WITH {_BOOST_SQL.format(source='documents')} SELECT doc_id, array_to_string(tk, ' ') AS heading_tokens FROM hd")
def document_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.filter(F.split(F.lower(retrieval.heading(F.col("text"))), "[^a-z0-9]+"), lambda t: t != "")
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens, " ").alias("heading_tokens"))


@query(f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(prose), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})))), ' ') AS terms FROM prompts")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator keeps the prompt's order; sorted here, as the check has no ordered distinct."""
    return _prompts(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(retrieval.query_terms(F.col("prose"))), " ").alias("terms"))


def _source_sql() -> str:
    parts = []
    for source, words in retrieval.SOURCE_KEYWORDS.items():
        single = "|".join(w for w in words if " " not in w and "-" not in w)
        phrases = "".join(f" OR contains(lower(prose), '{w}')" for w in words if " " in w or "-" in w)
        parts.append(f"CASE WHEN regexp_matches(lower(prose), '\\b({single})\\b'){phrases} THEN '{source}' END")
    return f"concat_ws(',', {', '.join(parts)})"


@query(f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, {_source_sql()} AS sources FROM prompts")
def source_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("conv_id", "turn", retrieval.source_intent(F.col("prose")).alias("sources"))


@query(
    f"""WITH {_PROMPTS_SQL}, f AS (SELECT conv_id, turn, target, regexp_matches(lower(prose), '{retrieval.CONFIG_SIGNALS}') AS c, target AND regexp_matches(lower(prose), '{retrieval.WRITE_VERBS}') AS w, regexp_matches(lower(prose), '{retrieval.QUERY_SIGNALS}') AS q FROM prompts)
SELECT conv_id, turn, CASE WHEN c THEN 'CONFIG' WHEN w THEN 'WRITE' ELSE 'QUERY' END AS intent, CAST(CASE WHEN c THEN CASE WHEN w OR target THEN 0.9 ELSE 0.8 END WHEN w AND NOT q THEN 0.85 WHEN w THEN 0.5 WHEN q THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM f"""
)
def intent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("conv_id", "turn", retrieval.intent(F.col("prose"), F.col("target")).alias("i")).select("conv_id", "turn", "i.intent", "i.confidence")


@query(f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, regexp_matches(lower(prose), '{retrieval.PEOPLE}') AS people, regexp_matches(lower(prose), '{retrieval.CODE_PLACES}') AND regexp_matches(lower(prose), '{retrieval.CODE_NOUNS}') AS code FROM prompts")
def people_and_code_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("prose")
    return _prompts(spark, sf_dir).select("conv_id", "turn", low.rlike(retrieval.PEOPLE).alias("people"), (low.rlike(retrieval.CODE_PLACES) & low.rlike(retrieval.CODE_NOUNS)).alias("code"))


@query(f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, CASE {' '.join(f'''WHEN regexp_matches(lower(prose), '{p}') THEN '{n}' ''' for n, p in retrieval.BLOCK_TYPES)} ELSE 'note' END AS type FROM prompts")
def block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("conv_id", "turn", retrieval.block_type(F.col("prose")).alias("type"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN length(s) <= 60 THEN s WHEN pos > 36 THEN left(s, CAST(pos - 1 AS BIGINT)) || '…' ELSE left(s, 60) || '…' END AS title
FROM (SELECT *, 61 - instr(reverse(left(s, 60)), ' ') AS pos FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS s FROM conversations WHERE role = 'user'))"""
)
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", strings.truncate_words(strings.squeezed(F.col("text")), 60).alias("title"))


@query("SELECT conv_id, count(*) AS messages, arg_max(md5(text), turn) AS latest, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.table(spark, sf_dir, "conversations").groupBy("conv_id")
    return found.agg(F.count("*").alias("messages"), F.max_by(F.md5("text"), "turn").alias("latest"), F.max("turn").alias("last_turn"))


@query("SELECT page_id, CASE WHEN length(u) > 42 THEN left(u, 41) || '…' ELSE u END AS label FROM (SELECT page_id, regexp_replace(url, '^https?://(www\\.)?', '') AS u FROM pages)")
def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", strings.short_url(F.col("url")).alias("label"))


@query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def sources_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("source").where("source <> ''").distinct()


@query(
    """WITH m AS (SELECT doc_id, source, lang, sha256(text) AS url, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS seen FROM documents)
SELECT doc_id, source, url FROM m WHERE seen = 1 ORDER BY doc_id LIMIT 8"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct citations among the documents, which stand for retrieved ones."""
    found = tables.table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("url")).agg(F.min("doc_id").alias("doc_id"))
    return found.orderBy("doc_id").limit(8).select("doc_id", "source", "url")


@query(
    """WITH s AS (SELECT doc_id, source, (doc_id * 7919 % 10007) / 10007 AS score FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS turn, first_value(score) OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS lead, first_value(doc_id) OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS one FROM s),
r AS (SELECT doc_id, source, row_number() OVER (ORDER BY turn, lead DESC, one) AS rank FROM t WHERE turn <= 3) SELECT * FROM r WHERE rank <= 25"""
)
def interleaved_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources take turns in the first 25 documents, with three of each at most; ids make up the scores."""
    scored = tables.table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") * 7919 % 10007 / 10007).alias("score"))
    return retrieval.interleaved(scored, "doc_id", "source", "score", 3, 25).select("doc_id", "source", "rank")


@query(
    f"""WITH prompts AS (SELECT conv_id, turn, text AS prose, CASE WHEN turn % 3 = 1 THEN ['slack', 'nowhere'] ELSE [] END AS mentioned, CASE WHEN turn % 2 = 0 THEN ['notion'] ELSE [] END AS targets,
CASE WHEN turn % 4 = 0 THEN 'WRITE' ELSE 'QUERY' END AS intent FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'slack' WHEN intent = 'QUERY' AND len(targets) > 0 THEN 'notion' ELSE {_source_sql()} END AS scope FROM prompts"""
)
def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that each turn of a conversation is limited to; turns' numbers make up mentions and targets."""
    none, turn = F.array().cast("array<string>"), F.col("turn")
    mentioned = F.when(turn % 3 == 1, F.array(F.lit("slack"), F.lit("nowhere"))).otherwise(none)
    targets = F.when(turn % 2 == 0, F.array(F.lit("notion"))).otherwise(none)
    intent = F.when(turn % 4 == 0, "WRITE").otherwise("QUERY")
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(retrieval.scope(mentioned, targets, intent, F.col("text")), ",").alias("scope"))


_EXCERPT_CHARS = 300


@query(
    f"""WITH d AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM documents), s AS (SELECT doc_id, list_filter(string_split(clean, chr(10)), lambda l: trim(l) <> '') AS lines FROM d WHERE length(clean) > {_EXCERPT_CHARS}),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM s WHERE len(lines) > 1),
h AS (SELECT *, CAST(contains(lower(line), 'the') AS INT) + CAST(contains(lower(line), 'ing') AS INT) AS hits, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS stop, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start FROM l),
w AS (SELECT a.doc_id, a.i, sum(b.hits) AS score, string_agg(b.line, ' ' ORDER BY b.i) AS passage FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.i >= a.i AND (b.i = a.i OR b.stop - a.start <= {_EXCERPT_CHARS}) GROUP BY ALL),
p AS (SELECT doc_id, CASE WHEN i > 0 THEN '… ' ELSE '' END || passage AS excerpt FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1)
SELECT doc_id, coalesce(p.excerpt, left(clean, {_EXCERPT_CHARS})) AS excerpt FROM d LEFT JOIN p USING (doc_id)"""
)
def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the lines that answer to two terms best."""
    return retrieval.excerpts(tables.table(spark, sf_dir, "documents"), ["the", "ing"], _EXCERPT_CHARS)
