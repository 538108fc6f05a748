"""Queries on rows of connectors: mapping, files, code, wiki pages, issues, and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators import connectors, drafts, retrieval
from quillmere.plans.registry import query
from quillmere.sources import tables

_SOURCES = ", ".join(f"'{s}'" for s in connectors.SOURCES)
_EXTENSIONS = ("py", "ts", "MD", "yaml", "png", "lock", "rs", "xyz")
_FOLDERS = ("src", "dist", "lib", "vendor", "docs")


def _pick(values: tuple[str, ...], place) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    f"""SELECT doc_id, CASE [{_SOURCES}][doc_id % 8 + 1] WHEN 'gmail' THEN 'subject' WHEN 'upload' THEN 'file_name' ELSE 'title' END AS title_key, left('About ' || lang, 512) AS title, sha256(text) AS digest, [{_SOURCES}][doc_id % 8 + 1] AS source,
CASE WHEN doc_id % 5 > 0 THEN source WHEN doc_id % 8 = 4 THEN 'ai' ELSE 'Unknown' END AS author FROM documents WHERE text <> '' OR doc_id % 8 <> 3
UNION ALL SELECT doc_id, 'title', 'About ' || lang, sha256('{{"body":""}}'), 'custom', CASE WHEN doc_id % 5 > 0 THEN source ELSE 'Unknown' END FROM documents WHERE text = '' AND doc_id % 8 = 3"""
)
def mapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to the eight sources; those of the custom source come as JSON objects, whose body the mapping takes out."""
    key = F.col("doc_id")
    made = tables.table(spark, sf_dir, "documents").select(
        "doc_id", _pick(connectors.SOURCES, key).alias("source"), F.when(key % 8 == 3, F.to_json(F.struct(F.col("text").alias("body")))).otherwise(F.col("text")).alias("content"),
        F.when(key % 5 > 0, F.col("source")).alias("author"), F.lit("1700000000").alias("timestamp"), F.concat(F.lit("About "), "lang").alias("subject"), F.lit("c1").alias("connector_id"), key.alias("external_id"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    found = connectors.mapped(made)
    names = F.array_except(F.map_keys("metadata"), F.array(F.lit("lang"), F.lit("connector_id"), F.lit("external_id")))
    return found.select("doc_id", F.get(names, 0).alias("title_key"), F.element_at("metadata", F.get(names, 0)).alias("title"), F.sha2("content", 256).alias("digest"), "source", "author")


@query(
    """WITH i AS (SELECT doc_id AS key, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS digest FROM documents), s AS (SELECT doc_id AS key, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0)
SELECT key, i.digest AS digest, CASE WHEN s.digest IS NULL THEN 'insert' WHEN s.digest = i.digest THEN 'skip' ELSE 'update' END AS action FROM i LEFT JOIN s USING (key)"""
)
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("payload"))
    changed = docs.withColumn("payload", F.when(F.col("key") % 3 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return connectors.merged_payloads(changed, docs.where("key % 2 = 0").select("key", F.sha2("payload", 256).alias("digest")))


_NAMES = ("notes.TXT", "report.pdf", "table", "letter.docx", "photo.jpg", "readme.md")
_MIMES = ("text/plain", "application/pdf", "text/csv", "image/png", "Application/JSON", "application/vnd.google-apps.document", "application/vnd.google-apps.folder")


@query(
    f"""WITH f AS (SELECT p_partkey, {_listed(_NAMES)}[p_partkey % 6 + 1] AS name, {_listed(_MIMES)}[p_partkey % 7 + 1] AS mime, (p_partkey % 11) * 3000000 AS size, p_size % 9 = 0 AS trashed FROM part),
k AS (SELECT *, CASE WHEN lower(name) LIKE '%.txt' OR lower(name) LIKE '%.md' THEN 'text' WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.docx' THEN 'docx'
  WHEN lower(mime) IN ('text/plain', 'text/csv', 'application/json') THEN 'text' WHEN mime = 'application/pdf' THEN 'pdf' END AS kind FROM f)
SELECT p_partkey, kind, CASE WHEN kind IS NULL THEN 'unsupported' WHEN size <= 0 THEN 'empty' WHEN size > 26214400 THEN 'too large' END AS error,
NOT trashed AND mime IN ('text/plain', 'application/pdf', 'text/csv', 'application/vnd.google-apps.document') AND size <= 20971520 AS readable FROM k"""
)
def files_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of several names, types and sizes: uploads and drive files that may be read."""
    key = F.col("p_partkey")
    name, mime, size = _pick(_NAMES, key), _pick(_MIMES, key), key % 11 * 3000000
    return tables.table(spark, sf_dir, "part").select("p_partkey", connectors.upload_kind(name, mime).alias("kind"), connectors.upload_error(name, mime, size).alias("error"), connectors.readable(mime, size, F.col("p_size") % 9 == 0).alias("readable"))


_PATHS_SQL = f"f AS (SELECT doc_id, {_listed(_FOLDERS)}[doc_id % 5 + 1] || '/' || lang || '/' || doc_id || '.' || {_listed(_EXTENSIONS)}[doc_id % 8 + 1] AS path, strlen(text) AS size FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository for each source."""
    key = F.col("doc_id")
    path = F.concat(_pick(_FOLDERS, key), F.lit("/"), "lang", F.lit("/"), key, F.lit("."), _pick(_EXTENSIONS, key))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content"))


@query(
    f"""WITH {_PATHS_SQL}, l AS (SELECT *, CASE WHEN path LIKE 'dist/%' OR path LIKE 'vendor/%' THEN NULL WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'js' WHEN path LIKE '%.MD' THEN 'markdown' WHEN path LIKE '%.yaml' THEN 'text' WHEN path LIKE '%.rs' THEN 'rust' END AS language FROM f)
SELECT doc_id, path, language, language IS NOT NULL AND size > 0 AND size <= 200000 AS indexed FROM l"""
)
def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", "path", connectors.code_language(F.col("path")).alias("language"), connectors.indexable(F.col("path"), F.octet_length("content")).alias("indexed"))


@query()
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all indexable files with their first lines; a test holds each against the file that it is from."""
    return connectors.code_chunks(_files(spark, sf_dir)).drop("body")


_KINDS = ("heading_1", "paragraph", "to_do", "quote", "bulleted_list_item", "code", "divider", "bookmark", "image", "child_page")


@query(
    f"""WITH p AS (SELECT c_custkey, c_name AS title, 'Segment: ' || c_mktsegment || chr(10) || 'Balance: ' || c_nationkey || chr(10) || 'Open: ' || CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END || chr(10) || 'When: 2024-01-01' || CASE WHEN c_custkey % 2 = 0 THEN ' → 2024-02-01' ELSE '' END || CASE WHEN c_custkey % 3 > 0 THEN chr(10) || 'Links: ' || c_custkey % 3 || ' linked item(s)' ELSE '' END AS details FROM customer),
b AS (SELECT o_custkey, o_orderkey, {_listed(_KINDS)}[o_orderkey % 10 + 1] AS kind, o_orderpriority AS t FROM orders),
l AS (SELECT o_custkey, o_orderkey, CASE kind WHEN 'heading_1' THEN '# ' || t WHEN 'paragraph' THEN t WHEN 'to_do' THEN '- [ ] ' || t WHEN 'quote' THEN '> ' || t WHEN 'bulleted_list_item' THEN '- ' || t WHEN 'code' THEN '```sql' || chr(10) || t || chr(10) || '```' WHEN 'bookmark' THEN 'sql — ' || t WHEN 'image' THEN '[image] sql — ' || t WHEN 'child_page' THEN '[Sub-page] ' || t END AS line FROM b),
g AS (SELECT o_custkey, string_agg(line, chr(10) ORDER BY o_orderkey) AS body FROM l GROUP BY 1)
SELECT c_custkey, '# ' || title || chr(10) || chr(10) || '## Details' || chr(10) || details || CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || body END AS document, true AS substance FROM p LEFT JOIN g ON o_custkey = c_custkey"""
)
def wiki_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages with properties, their orders as blocks of ten kinds."""
    customers, orders = tables.table(spark, sf_dir, "customer"), tables.table(spark, sf_dir, "orders")
    kind = _pick(_KINDS, F.col("o_orderkey"))
    blocks = orders.select("o_custkey", "o_orderkey", connectors.block_line(kind, F.col("o_orderpriority"), F.lit("sql")).alias("line"))
    body = blocks.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda b: b["line"]), "\n").alias("body"))
    key = F.col("c_custkey")
    text = lambda c: F.array(c.cast("string"))
    fields = (
        ("Name", "title", text(F.col("c_name"))), ("Segment", "select", text(F.col("c_mktsegment"))), ("Balance", "number", text(F.col("c_nationkey"))), ("Open", "checkbox", text(F.col("c_acctbal") > 0)),
        ("When", "date", F.array(F.lit("2024-01-01"), F.when(key % 2 == 0, "2024-02-01"))), ("Links", "relation", F.array_repeat(F.lit("x"), (key % 3).cast("int"))),
    )
    details = F.concat_ws("\n", *(connectors.property_line(F.lit(n), F.lit(k), v) for n, k, v in fields))
    pages = customers.join(body, key == F.col("o_custkey"), "left").select("c_custkey", "c_name", connectors.page_document(F.col("c_name"), details, F.col("body"), F.lit(None).cast("string")).alias("document"))
    return pages.select("c_custkey", "document", connectors.has_substance(F.col("document"), F.col("c_name")).alias("substance"))


@query("SELECT conv_id AS id, '# ' || 'Thread ' || conv_id || coalesce(chr(10) || chr(10) || string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (trim(text) <> ''), '') AS document, count(*) FILTER (trim(text) <> '') AS comments FROM conversations GROUP BY conv_id")
def thread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads, their turns as comments."""
    turns = tables.table(spark, sf_dir, "conversations")
    threads = turns.select(F.col("conv_id").alias("id")).distinct().select("id", F.concat(F.lit("Thread "), "id").alias("title"), F.lit(None).cast("string").alias("body"))
    found = connectors.discussions(threads, turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), F.col("role").alias("author"), F.col("text").alias("body")))
    return found.withColumn("comments", F.col("comments").cast("long"))


@query(
    """WITH l AS (SELECT o_custkey AS repo, o_orderkey AS sha, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders),
c AS (SELECT o_custkey AS repo, min(o_orderkey) AS sha FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), s AS (SELECT l.repo, place AS stop FROM l JOIN c ON l.repo = c.repo AND l.sha = c.sha)
SELECT repo, count(*) AS n, max(place) AS last FROM l LEFT JOIN s USING (repo) WHERE place <= 5 AND (stop IS NULL OR place < stop) GROUP BY repo"""
)
def commit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as commits, newest first, five at most; every second customer has seen the one with the smallest key."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("sha"), "o_orderdate")
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("o_orderdate"), F.desc("sha")))
    seen = orders.where("repo % 2 = 0").groupBy("repo").agg(F.min("sha").alias("sha"))
    found = connectors.until_cursor(orders.select("repo", "sha", place.cast("long").alias("place")), seen, 5)
    return found.groupBy("repo").agg(F.count("*").alias("n"), F.max("place").alias("last"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'merged' ELSE lower(o_orderstatus) END AS state, count(*) AS n FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1")
def issue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listed issues, each fifth the shadow of a pull request."""
    merged, shadow = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")), F.when(F.col("o_orderkey") % 5 == 0, "url")
    listed = connectors.issues(tables.table(spark, sf_dir, "orders").withColumn("pull_request", shadow))
    return listed.groupBy(connectors.issue_state(F.lower("o_orderstatus"), merged).alias("state")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN 'https://github.com/' || source || '/' || lang || '/blob/HEAD/src/f' || doc_id || '.py' || CASE WHEN doc_id % 4 > 0 THEN '#L' || doc_id ELSE '' END END AS url FROM documents"""
)
def code_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of code, with the place that a citation leads to; each sixth has no repository, each fourth no line."""
    doc_id = F.col("doc_id")
    repository = F.when(doc_id % 6 > 0, F.concat_ws("/", "source", "lang"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", connectors.blob_url(repository, F.concat(F.lit("src/f"), doc_id, F.lit(".py")), F.when(doc_id % 4 > 0, doc_id)).alias("url"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 99 ELSE c_nationkey END AS tenant_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def tenant_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("connection_id"), F.when(F.col("o_orderkey") % 3 == 0, 99).alias("tenant_id"))
    customers = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("connection_id"), F.col("c_nationkey").alias("tenant_id"))
    return connectors.backfilled(orders, customers).select("o_orderkey", "tenant_id")


@query(
    """WITH o AS (SELECT c_nationkey AS tenant_id, c_custkey AS id FROM customer), l AS (SELECT c_nationkey AS tenant_id, c_custkey AS source, c_custkey * 7 % 200 AS target FROM customer)
SELECT l.* FROM l WHERE EXISTS (FROM o WHERE o.tenant_id = l.tenant_id AND o.id = l.source) AND EXISTS (FROM o WHERE o.tenant_id = l.tenant_id AND o.id = l.target)"""
)
def owned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("id"))
    return connectors.owned_links(own.select("tenant_id", F.col("id").alias("source"), (F.col("id") * 7 % 200).alias("target")), own).select("tenant_id", "source", "target")


_BLOCKS_SQL = "b AS (SELECT source AS tenant_id, doc_id AS id, doc_id % 7 = 0 AS pinned, n_chars AS updated_at, CASE WHEN doc_id % 5 = 0 THEN 'archived' ELSE 'active' END AS status, lang AS title, text AS body FROM documents)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge blocks; their length stands for the time of the last change."""
    status = F.when(F.col("doc_id") % 5 == 0, "archived").otherwise("active")
    return tables.table(spark, sf_dir, "documents").select(
        F.col("source").alias("tenant_id"), F.col("doc_id").alias("id"), (F.col("doc_id") % 7 == 0).alias("pinned"), F.col("n_chars").alias("updated_at"), status.alias("status"), F.col("lang").alias("title"), F.col("text").alias("body")
    )


@query(f"WITH {_BLOCKS_SQL} SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY pinned DESC, updated_at DESC, id) AS place FROM b WHERE status = 'active' AND (lower(title) LIKE '%the%' OR lower(body) LIKE '%the%') QUALIFY place <= 30")
def blocks_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.blocks_found(_blocks(spark, sf_dir), "The").select("tenant_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_BLOCKS_SQL} SELECT tenant_id, id, status, row_number() OVER (PARTITION BY tenant_id ORDER BY pinned DESC, updated_at DESC, id) AS place FROM b")
def blocks_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.blocks_listed(_blocks(spark, sf_dir)).select("tenant_id", "id", "status", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey AS place, p_name AS id, p_brand AS label FROM part WHERE lower(p_name) LIKE '%a%' OR lower(p_brand) LIKE '%a%' ORDER BY p_partkey LIMIT 8")
def catalog_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a catalog, searched for @A; the limit is the menu's length."""
    catalog = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("id"), F.col("p_brand").alias("label"))
    return retrieval.catalog_found(catalog, " @A")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'p' || turn ELSE NULL END AS target, 'm1' AS model, CAST(1 AS BIGINT) AS context, 'Ask' AS prose FROM conversations")
def prompt_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with references to a page, models and an entity, which is named twice; labels don't stay in the prose."""
    page = F.struct(F.when(F.col("turn") % 2 == 0, "page").otherwise("other").alias("type"), F.concat(F.lit("p"), "turn").alias("id"), F.concat(F.lit("@p"), "turn").alias("label"))
    fixed = lambda kind, id: F.struct(F.lit(kind).alias("type"), F.lit(id).alias("id"), F.lit("@" + id).alias("label"))
    refs = F.array(page, fixed("model", "m1"), fixed("model", "n2"), fixed("entity", "chat"), fixed("entity", "chat"))
    found = retrieval.references(refs, F.concat(F.lit("@chat Ask @m1 @n2  @p"), "turn"))
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("r")).select("conv_id", "turn", F.get("r.targets", 0).alias("target"), "r.model", F.size("r.context").cast("long").alias("context"), "r.prose")


@query(
    """SELECT p_partkey AS id, 0 AS place, CASE WHEN p_size % 2 = 0 THEN 'decision' ELSE 'learned_fact' END AS type, p_name AS title, p_brand AS body, CASE WHEN p_size <= 25 THEN p_size / 25 ELSE 0.6 END AS confidence FROM part WHERE p_partkey % 4 <> 3
UNION ALL SELECT p_partkey, 2, 'learned_fact', 'More', p_type, 0.6 FROM part WHERE p_partkey % 4 <> 3"""
)
def answer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts out of answers in prose, in fences and in broken JSON, made of the parts; the second entry of each has no body."""
    first = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, "decision").otherwise("guess").alias("type"), F.col("p_name").alias("title"), F.col("p_brand").alias("body"), (F.col("p_size") / 25).alias("confidence")))
    last = F.to_json(F.struct(F.lit("More").alias("title"), F.col("p_type").alias("body")))
    array = F.concat(F.lit("["), first, F.lit(', {"title": "No body"}, '), last, F.lit("]"))
    way = F.col("p_partkey") % 4
    answer = F.when(way == 0, array).when(way == 1, F.concat(F.lit("Here:\n```json\n"), array, F.lit("\n```\nDone [1]."))).when(way == 2, F.concat(F.lit("I found "), array, F.lit(" in it"))).otherwise("[{ broken")
    return drafts.candidates(tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answer.alias("answer")))
