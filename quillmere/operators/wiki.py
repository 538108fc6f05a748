"""Incremental sync of wiki pages: what was edited since the cursor and isn't stored as it is, rows and cursor committed together."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import connectors

PAGE = "connection_id string, page_id string, edited_at timestamp, title string, document string, snippet string, author string, url string, status string"
CURSOR = "connection_id string, cursor timestamp"


def changed_pages(pages: DataFrame, stored: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows of PAGE to upsert, all PENDING, with skipped (null: to be stored; else why not).

    pages: connection_id, page_id, edited_at, title, properties, body, comments, author, url, as they were listed; of a page's several listings the last edited counts.
    Listed are those edited after their connection's cursor (cursors: connection_id, cursor; without one all). A page whose stored row has the
    same edited_at is skipped as unchanged, and one that says nothing beside its title as without substance.
    """
    after = pages.join(cursors.select("connection_id", "cursor"), "connection_id", "left").where(F.col("cursor").isNull() | (F.col("edited_at") > F.col("cursor")))
    rest = [c for c in pages.columns if c not in ("connection_id", "page_id")]
    once = after.groupBy("connection_id", "page_id").agg(F.max(F.struct("edited_at", *[c for c in rest if c != "edited_at"])).alias("p")).select("connection_id", "page_id", "p.*")
    known = stored.select("connection_id", "page_id", F.col("edited_at").alias("_held"))
    rows = once.join(known, ["connection_id", "page_id"], "left")
    document = connectors.page_document(F.col("title"), F.col("properties"), F.col("body"), F.col("comments"))
    rows = rows.withColumn("document", document)
    skipped = F.when(F.col("_held") == F.col("edited_at"), "unchanged").when(~connectors.has_substance(F.col("document"), F.col("title")), "no substance")
    return rows.select("connection_id", "page_id", "edited_at", "title", "document", F.left("document", F.lit(200)).alias("snippet"), "author", "url", F.lit("PENDING").alias("status"), skipped.alias("skipped"))


def advanced(cursors: DataFrame, stored_now: DataFrame) -> DataFrame:
    """Cursors moved to the last edit that was stored, never back."""
    seen = stored_now.groupBy("connection_id").agg(F.max("edited_at").alias("_seen"))
    return cursors.select("connection_id", "cursor").join(seen, "connection_id", "full").select("connection_id", F.greatest("cursor", "_seen").alias("cursor"))


class Store:
    """Pages and cursors in a shared folder, by batches: rows and cursors are written first, and are there when a batch's marker names them.

    A batch that was killed in between left no marker, and what it wrote is never read; run again, it starts from the tables and cursors of the batch before it. A batch that
    has its marker changes nothing when it is run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, re.sub(r"^file:/+", "/", path).rstrip("/")
        self._fs, self._root = fs.FileSystem.from_uri(self._path) if "://" in self._path else (fs.LocalFileSystem(), self._path)

    def _marker(self, batch: int) -> dict | None:
        try:
            with self._fs.open_input_stream(f"{self._root}/batches/{batch:010d}.json") as stream:
                return json.loads(stream.read())
        except FileNotFoundError:
            return None

    def last(self) -> int:
        """The number of the last batch that is there, -1 for none."""
        names = [x.base_name for x in self._fs.get_file_info(fs.FileSelector(f"{self._root}/batches", allow_not_found=True)) if x.base_name.endswith(".json")]
        return max((int(n[:10]) for n in names), default=-1)

    def _read(self, batch: int, table: str, schema: str) -> DataFrame:
        marker = self._marker(batch) if batch >= 0 else None
        return self._spark.read.schema(schema).parquet(f"{self._path}/{marker[table]}") if marker else self._spark.createDataFrame([], schema)

    def pages(self, batch: int | None = None) -> DataFrame:
        return self._read(self.last() if batch is None else batch, "pages", PAGE)

    def cursors(self, batch: int | None = None) -> DataFrame:
        return self._read(self.last() if batch is None else batch, "cursors", CURSOR)

    def sync(self, batch: int, listed: DataFrame, before_commit=lambda: None) -> bool:
        """Runs a batch over listed pages (see changed_pages); False if it had been committed. Batches are numbered without gaps."""
        if self._marker(batch) is not None:
            return False
        if batch != self.last() + 1:
            raise ValueError(f"batch {self.last() + 1} is next, not {batch}")
        stored, cursors, at = self.pages(batch - 1), self.cursors(batch - 1), f"data/{batch}-{uuid.uuid4().hex}"
        changed_pages(listed, stored, cursors).write.parquet(f"{self._path}/{at}/seen")
        seen = self._spark.read.parquet(f"{self._path}/{at}/seen")
        new = seen.where("skipped IS NULL").drop("skipped")
        stored.join(new.select("connection_id", "page_id"), ["connection_id", "page_id"], "left_anti").unionByName(new).write.parquet(f"{self._path}/{at}/pages")
        advanced(cursors, new).write.parquet(f"{self._path}/{at}/cursors")
        before_commit()
        self._fs.create_dir(f"{self._root}/batches", recursive=True)
        beside = f"{self._root}/batches/{uuid.uuid4().hex}.tmp"
        with self._fs.open_output_stream(beside) as out:
            out.write(json.dumps({"pages": f"{at}/pages", "cursors": f"{at}/cursors", "seen": f"{at}/seen"}).encode())
        self._fs.move(beside, f"{self._root}/batches/{batch:010d}.json")
        return True

    def to_queue(self, batch: int) -> DataFrame:
        """The pages that a batch stored, for the queue: they were read from its own table, so that it gives the same whenever it is asked."""
        marker = self._marker(batch)
        if marker is None:
            raise ValueError(f"no batch {batch}")
        return self._spark.read.parquet(f"{self._path}/{marker['seen']}").where("skipped IS NULL").drop("skipped")
