"""Tables that are only ever added to: numbered versions, each published once, chained by hashes, so that what was changed later is found.

    path/data/<uuid>/...            the rows of one append, each with its digest
    path/versions/<number>.json     what a version added: folder, rows, digests, and the hash of the version before

A version's file is created only if it isn't there; of two writers of the same number one succeeds, and the other takes the next. There is no
way to update or delete: a correction is a row of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGEST = "row_digest"


class Refused(RuntimeError):
    """Something else than an append was asked for."""


class Tampered(RuntimeError):
    """A version isn't what it was when it was published."""


def digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values under their names; nulls count, and the order of columns doesn't."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def _sums(rows: DataFrame) -> dict[str, str | int]:
    """Number of rows, and two sums over their digests that don't depend on their order."""
    part = lambda at: F.conv(F.substring(_DIGEST, at, 15), 16, 10).cast("decimal(38,0)")
    n, a, b = rows.agg(F.count("*"), F.coalesce(F.sum(part(1)), F.lit(0)), F.coalesce(F.sum(part(33)), F.lit(0))).first()
    return {"rows": n, "sum_a": str(a), "sum_b": str(b)}


class Ledger:
    """An append-only table in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{name}" if name else self._path)

    def versions(self) -> list[dict]:
        """What the published versions say of themselves, in order."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._text(f"versions/{n}")) for n in names]

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _published(self, version: dict) -> bool:
        """Creates the version's file; False if another writer was first."""
        try:
            out = self._fs.create(self._at(f"versions/{version['version']:010d}.json"), False)
        except Py4JJavaError as raised:
            if "AlreadyExists" in str(raised.java_exception):
                return False
            raise
        out.write(json.dumps(version, sort_keys=True).encode())
        out.close()
        return True

    @staticmethod
    def _hash(version: dict | None) -> str:
        return hashlib.sha256(json.dumps(version, sort_keys=True).encode()).hexdigest() if version else ""

    def append(self, rows: DataFrame, tries: int = 20) -> int:
        """Adds rows as the next version and returns its number. Columns must be those of the rows before."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_DIGEST, digest(rows.columns)).write.parquet(f"{self._path}/{folder}")
        sums = _sums(self._spark.read.parquet(f"{self._path}/{folder}"))
        columns = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
        for _ in range(tries):
            last = (self.versions() or [None])[-1]
            if last and sorted(last["columns"]) != sorted(columns):
                raise Refused(f"columns are {last['columns']}")
            number = last["version"] + 1 if last else 0
            if self._published({"version": number, "folder": folder, "columns": columns, "previous": self._hash(last), **sums}):
                return number
        raise Refused("other writers were first, each time")

    def update(self, *_) -> None:
        raise Refused("rows are never changed; append a correction")

    def delete(self, *_) -> None:
        raise Refused("rows are never deleted; append a correction")

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows up to a version, with the version that added them."""
        found = None
        for v in self.versions():
            if upto is None or v["version"] <= upto:
                own = self._spark.read.schema(", ".join(v["columns"])).parquet(f"{self._path}/{v['folder']}").withColumn("version", F.lit(v["version"]))
                found = own if found is None else found.unionByName(own)
        if found is None:
            raise Refused("there is no version yet")
        return found

    def changed(self) -> DataFrame:
        """Rows that aren't what was appended: version, row_digest as it was written, and the row as it is now."""
        found = None
        for v in self.versions():
            own = self._spark.read.schema(", ".join([*v["columns"], f"{_DIGEST} string"])).parquet(f"{self._path}/{v['folder']}")
            names = [c.split()[0] for c in v["columns"]]
            own = own.where(~F.col(_DIGEST).eqNullSafe(digest(names))).select(F.lit(v["version"]).alias("version"), _DIGEST, F.to_json(F.struct(*names)).alias("row"))
            found = own if found is None else found.unionByName(own)
        if found is None:
            raise Refused("there is no version yet")
        return found

    def verify(self) -> int:
        """The number of versions, if each follows the one before, has the rows that it had, and no row was changed; else raises Tampered."""
        before = None
        for k, v in enumerate(self.versions()):
            if v["version"] != k or v["previous"] != self._hash(before):
                raise Tampered(f"version {v['version']} doesn't follow the one before")
            rows = self._spark.read.schema(", ".join([*v["columns"], f"{_DIGEST} string"])).parquet(f"{self._path}/{v['folder']}")
            if _sums(rows) != {name: v[name] for name in ("rows", "sum_a", "sum_b")}:
                raise Tampered(f"rows of version {v['version']} are missing, new or changed")
            before = v
        if before is not None and (bad := self.changed().first()):
            raise Tampered(f"version {bad.version}, row {bad.row}")
        return 0 if before is None else before["version"] + 1
