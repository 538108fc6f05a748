"""A queue in a shared folder as a Spark data source: format("queue"), for batches and streams, reading and writing.

Each writer publishes batches under its own name, and a batch is there when its marker is. A batch that runs again after a
failure finds its marker and publishes nothing, so that a message is in the queue once however often its batch is tried. What a
reader has seen is an offset, the last batch of each writer; Spark's checkpoint keeps it over restarts. Nothing is removed by
reading; a group of readers acknowledges what it has finished, and the depth of the queue is what is left after that.

    frame.write.format("queue").mode("append").option("path", p).option("writer", "import-7").save()
    frame.writeStream.format("queue").option("path", p).option("writer", "w")...
    spark.readStream.format("queue").option("path", p).option("group", "g").load()
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: What is written; readers get the place of each message besides.
MESSAGE = "key string, value string"
READ = "writer string, batch long, position long, key string, value string"
_ARROW = pa.schema([("writer", pa.string()), ("batch", pa.int64()), ("position", pa.int64()), ("key", pa.string()), ("value", pa.string())])
_NAME = re.compile(r"[A-Za-z0-9_.-]{1,100}")


class Folder:
    """The queue's files: log/<writer>/<batch>/<segment>.arrow, with <batch>.done when it is published, and groups/<group>.json."""

    def __init__(self, path: str):
        self.path = re.sub(r"^file:/+", "/", path).rstrip("/")
        self._fs, self.root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _read(self, path: str) -> bytes | None:
        try:
            with self._fs.open_input_stream(path) as stream:
                return stream.read()
        except FileNotFoundError:
            return None

    def _put(self, path: str, content: bytes) -> None:
        """Whole or not at all: written beside, then moved."""
        self._fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        with self._fs.open_output_stream(beside) as stream:
            stream.write(content)
        self._fs.move(beside, path)

    def _names(self, path: str, kind: fs.FileType) -> list[str]:
        return sorted(x.base_name for x in self._fs.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == kind)

    def stage(self, writer: str, batches: Iterator[pa.RecordBatch]) -> Segment:
        """One task's messages as a file that belongs to no batch yet."""
        name, count = f"{uuid.uuid4().hex}.arrow", 0
        self._fs.create_dir(f"{self.root}/staged/{writer}", recursive=True)
        with self._fs.open_output_stream(f"{self.root}/staged/{writer}/{name}") as stream, pa.ipc.new_stream(stream, pa.schema([("key", pa.string()), ("value", pa.string())])) as out:
            for batch in batches:
                count += batch.num_rows
                out.write_batch(pa.record_batch([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())], names=["key", "value"]))
        return Segment(name, count)

    def publish(self, writer: str, batch: int, segments: list[Segment]) -> int:
        """Makes staged segments the writer's batch, unless there is one by that number; returns the queue's depth without acknowledgements."""
        at = f"{self.root}/log/{writer}/{batch:020d}"
        if self._read(f"{at}.done") is not None:
            self.discard(writer, segments)
        else:
            self._fs.create_dir(at, recursive=True)
            for segment in segments:
                self._fs.move(f"{self.root}/staged/{writer}/{segment.name}", f"{at}/{segment.name}")
            self._put(f"{at}.done", json.dumps({"segments": [[s.name, s.count] for s in segments]}).encode())
        return self.depth()

    def discard(self, writer: str, segments: list[Segment]) -> None:
        for segment in segments:
            try:
                self._fs.delete_file(f"{self.root}/staged/{writer}/{segment.name}")
            except FileNotFoundError:
                pass

    def published(self) -> dict[str, list[int]]:
        log = f"{self.root}/log"
        return {w: [int(n[:20]) for n in self._names(f"{log}/{w}", fs.FileType.File) if n.endswith(".done")] for w in self._names(log, fs.FileType.Directory)}

    def segments(self, writer: str, batch: int) -> list[Segment]:
        return [Segment(*x) for x in json.loads(self._read(f"{self.root}/log/{writer}/{batch:020d}.done") or b'{"segments":[]}')["segments"]]

    def messages(self, writer: str, batch: int, segment: str, start: int) -> Iterator[pa.RecordBatch]:
        with self._fs.open_input_stream(f"{self.root}/log/{writer}/{batch:020d}/{segment}") as stream:
            for some in pa.ipc.open_stream(stream):
                n = some.num_rows
                yield pa.record_batch([pa.array([writer] * n), pa.array([batch] * n, pa.int64()), pa.array(range(start, start + n), pa.int64()), some.column(0), some.column(1)], schema=_ARROW)
                start += n

    def acknowledge(self, group: str, offset: dict[str, int]) -> None:
        """Moves a group's offset forwards, never back."""
        known = self.acknowledged(group)
        self._put(f"{self.root}/groups/{group}.json", json.dumps(known | {w: max(b, known.get(w, -1)) for w, b in offset.items()}).encode())

    def acknowledged(self, group: str) -> dict[str, int]:
        return json.loads(self._read(f"{self.root}/groups/{group}.json") or b"{}")

    def depth(self, group: str | None = None) -> int:
        """Messages that the group hasn't acknowledged; without a group, all."""
        done = self.acknowledged(group) if group else {}
        return sum(s.count for w, batches in self.published().items() for b in batches if b > done.get(w, -1) for s in self.segments(w, b))


@dataclass
class Segment(WriterCommitMessage):
    """A file of messages, and how many it has; what a task tells the driver."""

    name: str
    count: int


@dataclass
class Span(InputPartition):
    """A segment of a published batch, and the place of its first message in the batch."""

    writer: str
    batch: int
    segment: str
    start: int

    def __post_init__(self) -> None:
        self.value = (self.writer, self.batch, self.segment, self.start)


class _Writing:
    def __init__(self, options: dict[str, str]):
        self.folder_path, self.writer = options["path"], options.get("writer") or f"once-{uuid.uuid4().hex}"
        if not _NAME.fullmatch(self.writer):
            raise ValueError(f"not a name: {self.writer!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        return Folder(self.folder_path).stage(self.writer, iterator)


class BatchWriter(_Writing, DataSourceArrowWriter):
    """A named writer's batch is its batch 0: saving it again adds nothing. Without a name each save adds."""

    def commit(self, messages: list[Segment | None]) -> None:
        Folder(self.folder_path).publish(self.writer, 0, [m for m in messages if m and m.count])

    def abort(self, messages: list[Segment | None]) -> None:
        Folder(self.folder_path).discard(self.writer, [m for m in messages if m])


class StreamWriter(_Writing, DataSourceStreamArrowWriter):
    """Micro-batches under Spark's numbers."""

    def commit(self, messages: list[Segment | None], batchId: int) -> None:  # noqa: N803  Spark's name
        Folder(self.folder_path).publish(self.writer, batchId, [m for m in messages if m and m.count])

    def abort(self, messages: list[Segment | None], batchId: int) -> None:  # noqa: N803
        Folder(self.folder_path).discard(self.writer, [m for m in messages if m])


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path, self.group = options["path"], options.get("group")

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list[Span]:
        folder, out = Folder(self.path), []
        for writer, batches in folder.published().items():
            for batch in batches:
                if start.get(writer, -1) < batch <= end.get(writer, -1):
                    at = 0
                    for segment in folder.segments(writer, batch):
                        out.append(Span(writer, batch, segment.name, at))
                        at += segment.count
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.segment:
            yield from Folder(self.path).messages(partition.writer, partition.batch, partition.segment, partition.start)


class BatchReader(_Reading, DataSourceReader):
    """All messages; with a group those that it hasn't acknowledged."""

    def partitions(self) -> list[Span]:
        folder = Folder(self.path)
        last = {w: b[-1] for w, b in folder.published().items() if b}
        return self.spans(folder.acknowledged(self.group) if self.group else {}, last) or [Span("", 0, "", 0)]


class StreamReader(_Reading, DataSourceStreamReader):
    """Micro-batches between offsets. A batch that Spark has committed is acknowledged for the group."""

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return Folder(self.path).acknowledged(self.group) if self.group else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {w: b[-1] for w, b in Folder(self.path).published().items() if b}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start, end)

    def commit(self, end: dict) -> None:
        if self.group:
            Folder(self.path).acknowledge(self.group, end)


class QueueSource(DataSource):
    """Options: path (a shared folder), writer (its name, for writing), group (whose acknowledgements count, for reading)."""

    @classmethod
    def name(cls) -> str:
        return "queue"

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("a queue is appended to")
        return BatchWriter(_checked(schema, self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        if "writer" not in self.options:
            raise ValueError("a stream writes under a name of its own, so that its batches can be told from others")
        return StreamWriter(_checked(schema, self.options))

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def _checked(schema, options: dict[str, str]) -> dict[str, str]:
    if [f.name for f in schema.fields] != ["key", "value"]:
        raise ValueError(f"messages are {MESSAGE}")
    return dict(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QueueSource)


def depth(path: str, group: str | None = None) -> int:
    """Messages in the queue that the group hasn't acknowledged."""
    return Folder(path).depth(group)
