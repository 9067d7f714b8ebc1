"""Versioned snapshots of a keyed table in plain files (S8, S9, §7.5-23): insert, patch, read as of a version, roll back.

A table is a folder. Rows are dealt into a fixed number of parts by the hash of their key; a write makes new files only for the
parts that it touches, in a folder of its own, and then commits a manifest that says in which folder each part lies. A reader takes one
manifest and is not disturbed by writers; what was written without a commit is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.operators import dedup

PART = "_part"


class SnapshotConflict(RuntimeError):
    """Another writer has changed a part since it was read."""


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: list[str]
    parts: int
    schema: str
    folders: dict[str, str]


class SnapshotTable:
    """``create`` once, then ``insert_absent`` and ``patch``; ``read`` a version; ``roll_back`` to one; ``vacuum`` old files.

    A commit is the creation of the manifest's file under the next number, which fails if the file exists (atomic in a distributed file
    system): of two writers one is first, and the other takes the next number if it touched other parts, else it raises
    ``SnapshotConflict`` and nothing has changed. An unreadable manifest (its writer died) is passed over.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _numbers(self) -> list[int]:
        folder = self._jvm.Path(f"{self.path}/_commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _load(self, version: int) -> Manifest | None:
        stream = self._fs.open(self._jvm.Path(f"{self.path}/_commits/{version:010d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest(**json.loads(text))
        except (ValueError, TypeError):
            return None

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or of the newest that is readable."""
        for n in [version] if version is not None else reversed(self._numbers()):
            if m := self._load(n):
                return m
        raise FileNotFoundError(f"no version at {self.path}")

    def versions(self) -> list[int]:
        return [n for n in self._numbers() if self._load(n)]

    def _commit(self, m: Manifest) -> bool:
        at = self._jvm.Path(f"{self.path}/_commits/{m.version:010d}")
        if self._fs.exists(at):
            return False
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            if self._fs.exists(at):
                return False
            raise e
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        return True

    def _publish(self, base: Manifest, changed: dict[str, str]) -> int:
        while True:
            last = self.manifest()
            if any(last.folders.get(p) != base.folders.get(p) for p in changed):
                raise SnapshotConflict(f"version {last.version} has changed parts that were read at version {base.version}")
            number = max(self._numbers()) + 1
            if self._commit(Manifest(number, base.keys, base.parts, base.schema, last.folders | changed)):
                return number

    # rows

    def _dealt(self, rows: DataFrame, m: Manifest) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(*m.keys), F.lit(m.parts)).cast("int"))

    def _write(self, rows: DataFrame, parts: Sequence[int]) -> dict[str, str]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.repartition(PART).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        written = {s.getPath().getName() for s in self._fs.listStatus(self._jvm.Path(f"{self.path}/{folder}"))}
        return {str(p): f"{folder}/{PART}={p}" if f"{PART}={p}" in written else "" for p in parts}

    def _rows(self, m: Manifest, parts: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        at = [f"{self.path}/{f}" for p, f in m.folders.items() if f and (parts is None or int(p) in parts)]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def create(self, rows: DataFrame, keys: Sequence[str], parts: int = 64) -> int:
        """Version 1 of the table. One key has one row: that is the caller's (``insert_absent`` into an empty table sees to it)."""
        m = Manifest(1, list(keys), parts, rows.schema.json(), {})
        if self._numbers():
            raise SnapshotConflict(f"{self.path} is a table already")
        folders = self._write(self._dealt(rows, m), range(parts))
        if not self._commit(Manifest(1, m.keys, parts, m.schema, {p: f for p, f in folders.items() if f})):
            raise SnapshotConflict(f"{self.path} is a table already")
        return 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest); later writes do not reach a frame that was read."""
        return self._rows(self.manifest(version))

    def _rewrite(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """``change(target, rows)`` over the parts that ``rows`` have keys in; the others' files stay as they are."""
        m = self.manifest()
        dealt = self._dealt(rows, m)
        parts = [r[0] for r in dealt.select(PART).distinct().collect()]  # at most the fixed number of parts
        if not parts:
            return m.version
        new = change(self._rows(m, parts), rows)
        return self._publish(m, self._write(self._dealt(new, m), parts))

    def insert_absent(self, incoming: DataFrame, order: str) -> int:
        """Rows whose key is new; of several with one key the first by ``order``. Returns the version."""
        keys = self.manifest().keys
        return self._rewrite(incoming, lambda target, rows: target.unionByName(dedup.insert_if_absent(target, rows, keys, order=order)))

    def patch(self, patches: DataFrame) -> int:
        """Non-null fields of the (unique) patches replace those of the rows with their key; keys without row are left out."""
        keys = self.manifest().keys
        return self._rewrite(patches, lambda target, rows: dedup.patch_by_key(target, rows, keys))

    def roll_back(self, version: int) -> int:
        """A new version with the files of an older one."""
        old, last = self.manifest(version), self.manifest()
        number = max(self._numbers()) + 1
        if not self._commit(Manifest(number, last.keys, last.parts, old.schema, old.folders)):
            raise SnapshotConflict("another version was committed meanwhile")
        return number

    def vacuum(self, keep: int = 10) -> int:
        """Delete the manifests before the last ``keep`` versions and the files that no version left names; returns the number of folders deleted.

        Run it when nobody reads the older versions and no write is under way.
        """
        versions = self.versions()
        for n in versions[:-keep]:
            self._fs.delete(self._jvm.Path(f"{self.path}/_commits/{n:010d}"), False)
        used = {f for n in versions[-keep:] for f in self._load(n).folders.values()}
        gone = 0
        for write in self._fs.listStatus(self._jvm.Path(f"{self.path}/data")):
            for part in self._fs.listStatus(write.getPath()):
                if part.isDirectory() and f"data/{write.getPath().getName()}/{part.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(part.getPath(), True))
        return gone


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ``change`` (inserted, changed, deleted) of the rows that two versions differ in."""
    fields = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.struct(*fields).alias("_old"))
    both = old.join(after.select(*keys, F.struct(*fields).alias("_new")), list(keys), "full_outer")
    kind = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*keys, kind.alias("change")).where("change IS NOT NULL")
