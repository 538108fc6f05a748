"""Rows of connectors as documents: mapping by source, wiki pages, code files, issues, files worth reading, changed payloads."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators import ingestion, text
from quillmere.sources import staging

#: Sources that can be mapped, the longest title, and the kinds and sizes of files that can be read.
SOURCES = ("gmail", "notion", "github", "custom", "brain", "upload", "slack", "drive")
TITLE_CHARS = 512
EXTENSION_KINDS = {"txt": "text", "md": "text", "markdown": "text", "csv": "text", "json": "text", "log": "text", "pdf": "pdf", "docx": "docx"}
MIME_KINDS = {
    "text/plain": "text", "text/markdown": "text", "text/csv": "text", "application/json": "text", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
}
DRIVE_MIMES = (
    "application/vnd.google-apps.document", "application/vnd.google-apps.presentation", "application/vnd.google-apps.spreadsheet",
    "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain", "text/markdown", "text/csv",
)
UPLOAD_BYTES, DRIVE_BYTES, CODE_BYTES = 25 * 1024 * 1024, 20 * 1024 * 1024, 200_000

#: Languages of code by extension and by name, extensions of plain text, and paths that are never read.
LANGUAGES = {
    "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "python", "go": "go", "java": "java", "rb": "ruby", "rs": "rust", "php": "php",
    "scala": "scala", "swift": "swift", "sol": "sol", "proto": "proto", "c": "cpp", "h": "cpp", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "md": "markdown", "mdx": "markdown",
    "rst": "rst", "html": "html", "tex": "latex",
}
PLAIN_EXTENSIONS = (
    "txt", "json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "sql", "sh", "bash", "zsh", "ps1", "dockerfile", "gradle", "properties",
    "css", "scss", "less", "graphql", "gql", "prisma", "vue", "svelte",
)
NAMED_FILES = {"dockerfile": "text", "makefile": "text", "procfile": "text", "readme": "markdown"}
#: Paths that aren't indexed, whatever the case of their letters.
EXCLUDED_PATHS = (
    r"(^|/)node_modules/",
    r"(^|/)\.git/",
    r"(^|/)\.next/",
    r"(^|/)dist/",
    r"(^|/)build/",
    r"(^|/)out/",
    r"(^|/)coverage/",
    r"(^|/)vendor/",
    r"(^|/)__pycache__/",
    r"(^|/)\.venv/",
    r"(^|/)venv/",
    r"(^|/)target/",
    r"(^|/)generated/",
    r"(^|/)migrations?/",
    r"\.min\.(js|css)$",
    r"\.(lock|lockb)$",
    r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|poetry\.lock|Cargo\.lock|Gemfile\.lock|composer\.lock)$",
    r"\.(png|jpe?g|gif|svg|ico|webp|bmp|pdf|zip|gz|tar|jar|war|so|dylib|dll|exe|bin|wasm|woff2?|ttf|eot|mp[34]|mov|avi)$",
    r"\.(snap|map)$",
)
EXCLUDED = "(?i)" + "|".join(EXCLUDED_PATHS)
#: Where code is cut first, by language; other languages are cut at blank lines, lines and spaces only.
BOUNDARIES = {
    "python": ("\nclass ", "\ndef ", "\n\tdef "),
    "js": ("\nfunction ", "\nconst ", "\nlet ", "\nclass "),
    "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype "),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic "),
    "rust": ("\nfn ", "\nconst ", "\nlet "),
    "markdown": ("\n## ", "\n### ", "\n#### "),
}
CODE_CHARS, CODE_OVERLAP = 1200, 150

_map = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
_text = lambda c: F.coalesce(c, F.lit(""))
_given = lambda c: F.when(F.trim(c) != "", c)


# --- payloads to documents --------------------------------------------------------------------------------------


def unwrapped(content: Column) -> Column:
    """The body, else the text, of content that is a JSON object; other content, objects without either too, stays as it is."""
    field = lambda path: F.nullif(F.get_json_object(content, path), F.lit(""))
    return F.when(F.startswith(F.trim(content), F.lit("{")), F.coalesce(field("$.body"), field("$.text"), content)).otherwise(content)


def mapped(payloads: DataFrame) -> DataFrame:
    """Documents of payloads (source, content, author, timestamp, subject, connector_id, external_id, metadata map), all other columns kept.

    JSON bodies of the custom source are unwrapped. The subject's name in the metadata is ``subject`` for mail, ``file_name`` for uploads and ``title`` for the rest; drafts without
    an author are the assistant's own. An unknown source fails the query.
    """
    source = F.col("source")
    known = F.when(source.isin(*SOURCES), source).otherwise(F.raise_error(F.concat(F.lit("no mapping for source "), _text(source))))
    named = F.when(source == "gmail", "subject").when(source == "upload", "file_name").otherwise("title")
    title = F.left(F.nullif(F.col("subject"), F.lit("")), F.lit(TITLE_CHARS))
    own = F.map_filter(F.create_map(F.lit("connector_id"), F.col("connector_id").cast("string"), F.lit("external_id"), F.col("external_id").cast("string"), named, title), lambda k, v: v.isNotNull())
    given = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(own, k))
    return payloads.select(
        *(c for c in payloads.columns if c not in ("source", "content", "author", "timestamp", "metadata")),
        known.alias("source"), F.when(source == "custom", unwrapped(F.col("content"))).otherwise(F.col("content")).alias("content"),
        ingestion.author(F.coalesce("author", F.when(source == "brain", "ai"))).alias("author"), ingestion.parsed_time(F.col("timestamp")).alias("timestamp"), F.map_concat(given, own).alias("metadata"),
    )


def merged_payloads(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """key, digest, action of each incoming payload (key, payload) against the stored digests: insert, update, or skip where nothing changed.

    Of several payloads with one key the one with the greatest digest counts, so that the result doesn't depend on their order.
    """
    once = incoming.groupBy("key").agg(F.max(F.sha2("payload", 256)).alias("digest"))
    held = stored.select("key", F.col("digest").alias("_held"))
    action = F.when(F.col("_held").isNull(), "insert").when(F.col("_held") == F.col("digest"), "skip").otherwise("update")
    return once.join(held, "key", "left").select("key", "digest", action.alias("action"))


# --- files ------------------------------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, empty if there is none or the name only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def upload_kind(name: Column, mime: Column) -> Column:
    """text, pdf or docx by extension, else by type; null for others."""
    return F.coalesce(F.element_at(_map(EXTENSION_KINDS), F.lower(F.element_at(F.split(name, r"\."), -1))), F.element_at(_map(MIME_KINDS), F.lower(mime)))


def upload_error(name: Column, mime: Column, size: Column) -> Column:
    """Why an upload is refused; null for one that is taken."""
    return F.when(upload_kind(name, mime).isNull(), "unsupported").when(size <= 0, "empty").when(size > UPLOAD_BYTES, "too large")


def readable(mime: Column, size: Column, trashed: Column) -> Column:
    """Files of a drive that have text to read; a size that isn't known doesn't count against them."""
    return ~F.coalesce(trashed, F.lit(False)) & F.coalesce(mime.isin(*DRIVE_MIMES), F.lit(False)) & F.coalesce(size <= DRIVE_BYTES, F.lit(True))


def code_language(path: Column) -> Column:
    """The language that a file is cut as, text for plain files, null for what isn't indexed."""
    found = extension(path)
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(path.rlike(EXCLUDED), F.lit(None)).when(found == "", F.element_at(_map(NAMED_FILES), name)).otherwise(F.coalesce(F.element_at(_map(LANGUAGES), found), F.when(found.isin(*PLAIN_EXTENSIONS), "text")))


def indexable(path: Column, size: Column) -> Column:
    return F.coalesce((size > 0) & (size <= CODE_BYTES), F.lit(False)) & code_language(path).isNotNull()


def _pieces(content: str, language: str) -> list[tuple[int, str]]:
    """(first line, piece) of a file: cut before declarations, then at blank lines, lines and spaces; each piece but the first repeats its predecessor's last lines, up to CODE_OVERLAP characters."""
    marked = content
    for boundary in BOUNDARIES.get(language, ()):
        marked = marked.replace(boundary, "\n\0" + boundary[1:])
    cut = text.split_text(marked, CODE_CHARS - CODE_OVERLAP, ("\0", "\n\n", "\n", " "))
    ends = [i for i, c in enumerate(content) if c == "\n"]
    out: list[tuple[int, str]] = []
    at = 0
    for piece in (p.replace("\0", "") for p in cut):
        start = content.index(piece, at)
        at = start + len(piece)
        first = bisect.bisect_left(ends, start - CODE_OVERLAP)
        repeated = ends[first] + 1 if out and first < len(ends) and ends[first] < start else start
        own = content[repeated:at]
        lead = len(own) - len(own.lstrip("\n"))
        out.append((bisect.bisect_left(ends, repeated + lead) + 1, own.strip("\n")))
    return out


def code_chunks(files: DataFrame) -> DataFrame:
    """repo, path, language, part, parts, line and text of the chunks of indexable files (repo, path, content), with a header that names where each is from.

    Pieces have at most CODE_CHARS characters and lose nothing but blank lines at their ends; null bytes in a file are taken for boundaries. Nulls and empty files give no rows.
    """

    staging.small_batches(files.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, language, content in batch.itertuples(index=False):
                pieces = _pieces(content.replace("\0", ""), language)
                rows += [(repo, path, language, i, len(pieces), line, piece) for i, (line, piece) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=["repo", "path", "language", "part", "parts", "line", "body"])

    own = files.where(indexable(F.col("path"), F.octet_length("content"))).select(F.col("repo").cast("string"), "path", code_language(F.col("path")).alias("language"), "content")
    found = own.mapInPandas(cut, "repo string, path string, language string, part int, parts int, line int, body string")
    return found.withColumn("text", code_header(F.col("repo"), F.col("path"), F.col("language"), F.col("line"), F.col("part"), F.col("parts"), F.col("body")))


def code_header(repo: Column, path: Column, language: Column, line: Column, part: Column, parts: Column, body: Column) -> Column:
    """A chunk under the lines that say where it is from, so that words of the path find it."""
    return F.format_string("# %s\nrepository: %s | language: %s | L%s | part %s/%s\n\n%s", path, _text(repo), language, line, part, parts, body)


def without_header(chunk: Column) -> Column:
    """A chunk's code without the lines that code_header put above it."""
    return F.regexp_replace(chunk, r"\A# [^\n]*\n(repository:[^\n]*\n)?\n*", "")


def blob_url(repository: Column, path: Column, line: Column) -> Column:
    """Where a chunk of code is read: the file at its repository's head, at the line it begins with; null without a repository or a path."""
    at = F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise("")
    named = (F.coalesce(repository, F.lit("")) != "") & (F.coalesce(path, F.lit("")) != "")
    return F.when(named, F.concat(F.lit("https://github.com/"), repository, F.lit("/blob/HEAD/"), path, F.coalesce(at, F.lit(""))))


# --- wiki pages -------------------------------------------------------------------------------------------------


def property_line(name: Column, kind: Column, values: Column) -> Column:
    """``name: value`` of a page's property with its values as strings, null for one that has nothing to say.

    Dates of two values are a range; people, files and the like are lists; check boxes say Yes or No; relations only count.
    """
    some = F.filter(values, lambda v: F.trim(v) != "")
    first = F.get(some, 0)
    flag = F.when(F.get(values, 0) == "true", "Yes").otherwise("No")
    value = (
        F.when(kind == "title", None).when(kind == "checkbox", flag).when(F.size(some) == 0, None).when(kind == "date", F.array_join(F.slice(some, 1, 2), " → "))
        .when(kind == "relation", F.format_string("%d linked item(s)", F.size(some))).when(kind == "unique_id", F.array_join(some, "-"))
        .when(kind.isin("multi_select", "people", "files", "rollup"), F.array_join(some, ", ")).otherwise(first)
    )
    return F.when(_given(value).isNotNull(), F.concat(name, F.lit(": "), value))


def block_line(kind: Column, body: Column, extra: Column) -> Column:
    """A block as a line of Markdown; extra is a code block's language, a check mark ("true"), or the address or name beside a caption. Null for what has no text."""
    said, beside = F.trim(_text(body)), F.trim(_text(extra))
    under = lambda prefix: F.when(said != "", F.concat(F.lit(prefix), said))
    both = _given(F.concat_ws(" — ", _given(beside), _given(said)))
    return (
        F.when(kind == "heading_1", under("# ")).when(kind == "heading_2", under("## ")).when(kind == "heading_3", under("### "))
        .when(kind.isin("bulleted_list_item", "numbered_list_item"), under("- "))
        .when(kind == "to_do", F.when(beside == "true", under("- [x] ")).otherwise(under("- [ ] ")))
        .when(kind.isin("quote", "callout"), under("> ")).when(kind == "code", F.when(said != "", F.concat(F.lit("```"), beside, F.lit("\n"), said, F.lit("\n```"))))
        .when(kind == "child_page", under("[Sub-page] ")).when(kind == "child_database", under("[Database] ")).when(kind.isin("bookmark", "embed", "link_preview"), both)
        .when(kind.isin("image", "video", "file", "pdf", "audio"), F.concat(F.lit("["), kind, F.lit("] "), both))
        .when(kind.isin("paragraph", "toggle", "template", "equation", "table_row"), _given(said))
    )


def page_document(title: Column, properties: Column, body: Column, comments: Column) -> Column:
    """A page's title, details, body and discussion; sections without text are left out."""
    section = lambda head, c: F.when(F.trim(_text(c)) != "", F.concat(F.lit(head), F.trim(c)))
    named = F.when((_text(title) != "") & (title != "(untitled)"), F.concat(F.lit("# "), title))
    return F.concat_ws("\n\n", named, section("## Details\n", properties), section("", body), section("## Discussion\n", comments))


def has_substance(document: Column, title: Column, least: int = 10) -> Column:
    """Whether a document says at least so much beside its title."""
    head = F.concat(F.lit("# "), _text(title))
    rest = F.when(F.startswith(document, head), F.substring(document, F.length(head) + 1, F.length(document))).otherwise(document)
    return F.length(F.trim(F.regexp_replace(rest, r"\A\s+|\s+\z", ""))) >= least


# --- repositories -----------------------------------------------------------------------------------------------


def issue_state(state: Column, merged_at: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").otherwise(state)


def issues(listed: DataFrame) -> DataFrame:
    """Rows of a listing of issues that are issues: a listing also has the shadows of pull requests, which name their pull_request and are synced by themselves."""
    return listed.where(F.col("pull_request").isNull()).drop("pull_request")


def discussions(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """id, document, comments of each thread (id, title, body): its text and then its comments (id, at, author, body) in order of time, author and body, one paragraph each."""
    said = comments.where(F.trim(_text(F.col("body"))) != "").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "author", "body"))).alias("_said"))
    lines = F.transform("_said", lambda c: F.concat(_text(c["author"]), F.lit(": "), c["body"]))
    document = F.concat_ws("\n\n", F.concat(F.lit("# "), _text(F.col("title"))), _given(F.col("body")), _given(F.array_join(lines, "\n\n")))
    return threads.join(said, "id", "left").select("id", document.alias("document"), F.coalesce(F.size("_said"), F.lit(0)).alias("comments"))


def until_cursor(listed: DataFrame, cursors: DataFrame, most: int = 500) -> DataFrame:
    """Commits (repo, sha, place from 1 for the newest) above the place of a repository's cursor (repo, sha), the first ``most``; all where there is no cursor or it isn't listed."""
    stop = cursors.join(listed, ["repo", "sha"]).groupBy("repo").agg(F.min("place").alias("_stop"))
    return listed.where(F.col("place") <= most).join(stop, "repo", "left").where(F.col("_stop").isNull() | (F.col("place") < F.col("_stop"))).drop("_stop")


def backfilled(rows: DataFrame, connections: DataFrame) -> DataFrame:
    """Rows of connection_id with the tenant of their connection (connection_id, tenant_id) where they have none of their own."""
    owner = connections.select("connection_id", F.col("tenant_id").alias("_owner"))
    return rows.join(owner, "connection_id", "left").withColumn("tenant_id", F.coalesce("tenant_id", "_owner")).drop("_owner")


def owned_links(links: DataFrame, owned: DataFrame) -> DataFrame:
    """Links (tenant_id, source, target) of which the tenant owns both ends (tenant_id, id)."""
    end = lambda column: owned.select("tenant_id", F.col("id").alias(column)).distinct()
    return links.join(end("source"), ["tenant_id", "source"], "left_semi").join(end("target"), ["tenant_id", "target"], "left_semi")


def blocks_listed(blocks: DataFrame) -> DataFrame:
    """Adds place to blocks (tenant_id, id, pinned, updated_at): pinned ones first, then the latest, of equal ones the smaller id."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("pinned"), F.desc("updated_at"), "id")))


def blocks_found(blocks: DataFrame, words: str, most: int = 30) -> DataFrame:
    """The first active blocks of each tenant, in their listed order, whose title or body holds the words in any case."""
    hit = lambda c: F.contains(F.lower(_text(F.col(c))), F.lit(words.lower()))
    return blocks_listed(blocks.where((F.col("status") == "active") & (hit("title") | hit("body")))).where(F.col("place") <= most)
