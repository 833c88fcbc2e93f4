"""Tables whose versions are published atomically.

A table is a folder of immutable data folders and numbered manifests::

    <path>/data/<unique name>/...        Parquet written by Spark; never changed
    <path>/versions/0000000007.json      which data folders make up version 7, by part

A writer stages data folders first and then publishes one manifest by a rename that fails if the
version exists. Readers take the newest manifest, so they see the old table or the new one, never a
mixture; a writer killed before its rename leaves the old table, and two writers cannot both
publish the same version. A part is a named piece of the table (a month, say): a new version lists new folders for
the parts that changed and inherits the others.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The only part of a table that is not split.
WHOLE = "all"
#: The part of rows without a value in the part column.
NO_VALUE = "none"


class ConcurrentPublish(PySparkException):
    """Another writer has published the version that this one was about to publish."""


@dataclass(frozen=True)
class Manifest:
    """One version. ``parts``: data folders (relative to the table) by part; ``marks``: what has been applied, by source."""
    version: int
    schema: str
    parts: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._hadoop.fs.Path("/".join((self.path, *parts)))

    @property
    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def _children(self, *parts: str) -> list:
        fs, folder = self._fs, self._at(*parts)
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._children("versions"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The given version, or the newest one; None if there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        name = f"{known[-1] if version is None else version:010d}.json"
        stream = self._fs.open(self._at("versions", name))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def stage(self) -> tuple[str, str]:
        """A fresh data folder: its full path, and its name relative to the table."""
        name = f"data/{int(time.time())}-{uuid.uuid4().hex}"
        return f"{self.path}/{name}", name

    def staged_parts(self, name: str, column: str) -> dict[str, str]:
        """The part folders of a staged folder that was written by ``partitionBy(column)``."""
        found = {}
        for s in self._children(name):
            key, _, value = s.getPath().getName().partition("=")
            if s.isDirectory() and key == column:
                found[value] = f"{name}/{key}={value}"
        return found

    def write(self, df: DataFrame, column: str | None = None) -> dict[str, list[str]]:
        """Stage ``df``, split by the values of ``column`` if given: new data folders by part, not published yet.

        Rows without a value go to the part ``none``; equal values meet in few files, and a value with many rows is
        spread over several tasks.
        """
        full, name = self.stage()
        if column is None:
            df.write.parquet(full)
            return {WHOLE: [name]}
        filled = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(NO_VALUE)))
        filled.hint("rebalance", column).write.partitionBy(column).parquet(full)
        return {value: [folder] for value, folder in self.staged_parts(name, column).items()}

    def publish(self, base: Manifest | None, schema: T.StructType, parts: dict[str, list[str]], marks: dict[str, int] | None = None) -> Manifest:
        """Make ``parts`` the version after ``base`` (the manifest this writer started from)."""
        new = Manifest((base.version if base else 0) + 1, schema.json(), parts, marks if marks is not None else dict(base.marks if base else {}))
        draft = self._at("versions", f".draft-{uuid.uuid4().hex}")
        fs = self._fs
        fs.mkdirs(self._at("versions"))
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            out.close()
        context = self._hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._at("versions", f"{new.version:010d}.json"), no_overwrite)
        except Exception as e:
            fs.delete(draft, False)
            if new.version in self.versions():
                raise ConcurrentPublish(f"version {new.version} of {self.path} exists already") from e
            raise
        return new

    def replace(self, df: DataFrame) -> Manifest:
        """Truncate-and-load: the rows of ``df`` become the whole table."""
        base = self.manifest()
        return self.publish(base, df.schema, self.write(df))

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of the given parts (all by default) of the newest or given version; None without a version."""
        m = self.manifest(version)
        return None if m is None else self.rows(m, parts)

    def rows(self, m: Manifest, parts: Iterable[str] | None = None) -> DataFrame:
        wanted = sorted(m.parts) if parts is None else [p for p in parts if p in m.parts]
        schema = T.StructType.fromJson(json.loads(m.schema))
        return self.folders([f for p in wanted for f in m.parts[p]], schema)

    def folders(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def vacuum(self, keep: int = 2, older_than_seconds: float = 86400.0) -> int:
        """Drop all but the newest ``keep`` versions, and the data folders that none of these lists and that are older
        than a running writer could be; the number of data folders deleted."""
        fs, known = self._fs, self.versions()
        used = {"/".join(f.split("/")[:2]) for v in known[-keep:] for own in self.manifest(v).parts.values() for f in own}
        for v in known[:-keep]:
            fs.delete(self._at("versions", f"{v:010d}.json"), False)
        gone = 0
        for s in self._children("data"):
            name = s.getPath().getName()
            if f"data/{name}" not in used and int(name.split("-")[0]) <= time.time() - older_than_seconds:
                fs.delete(s.getPath(), True)
                gone += 1
        return gone


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table at ``path``."""
    found = VersionedTable(spark, path).read()
    if found is None:
        raise FileNotFoundError(f"no published table at {path}")
    return found
