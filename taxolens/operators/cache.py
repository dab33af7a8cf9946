"""Answers of models kept as a bucketed table with snapshots.

A cache is a folder of Parquet files bucketed by key. ``_current`` names the version that
holds: the first lies in the folder itself, later ones in folders of their own. It is
replaced at once, so a reader finds one version or the next. A join
with the cache shuffles what is asked to the buckets and reads the cache where it lies.
Appending adds files to the buckets; a version with many is written anew, compacted, as
the next, and the one before it stays for readers that have begun.

An append that is run again leaves the same answers twice, which are read as one: of
several answers to a key the least counts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new cache, and files a bucket may have before it is compacted.
BUCKETS, MOST_FILES = 64, 8
_BUCKETED = re.compile(r"_\d{5}(\.c\d+)?\.[a-z.]*parquet$")


class CacheError(RuntimeError):
    """A folder that holds something else than a cache."""


class Cache:
    """``schema``: ``key string`` first, then the columns of an answer."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.buckets = spark, folder, schema, buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._root = self._jvm.Path(folder)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(self._root):
            stray = [n for n in self._names(self._root) if not n.startswith(("_", ".")) and not _BUCKETED.search(n)]
            if stray:
                raise CacheError(f"{folder} holds files that aren't a cache's: {stray[0]}")
        spec = self._read("_buckets")
        if spec:
            self.buckets = int(spec)

    # -- files
    def _names(self, path) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(path)]

    def _read(self, name: str) -> str | None:
        path = self._jvm.Path(self._root, name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return stream.readLine()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """A small file, whole or not at all."""
        self._fs.mkdirs(self._root)
        fresh, path = self._jvm.Path(self._root, f"_{name}.new"), self._jvm.Path(self._root, name)
        out = self._fs.create(fresh, True)
        out.writeBytes(text + "\n")
        out.close()
        uri, hadoop = self._fs.getUri(), self.spark._jsc.hadoopConfiguration()
        overwrite = self.spark._sc._gateway.new_array(self._jvm.Options.Rename, 1)
        overwrite[0] = self._jvm.Options.Rename.OVERWRITE
        self._jvm.FileContext.getFileContext(uri, hadoop).rename(self._fs.makeQualified(fresh), self._fs.makeQualified(path), overwrite)

    def version(self) -> int:
        """The number of the version that holds; 0 for none."""
        return int(self._read("_current") or 0)

    def _place(self, version: int) -> str:
        return self.folder.rstrip("/") + (f"/_version-{version:06d}" if version > 1 else "")

    def _table(self, version: int) -> str:
        """The name of the version's table in this session."""
        place = self._place(version)
        name = "taxolens_cache_" + hashlib.md5(place.encode()).hexdigest()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(self.schema))
        self._fs.mkdirs(self._jvm.Path(place))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(name)
        return name

    def files(self) -> list[str]:
        """Names of the data files of the version that holds."""
        return [n for n in self._names(self._jvm.Path(self._place(self.version()))) if not n.startswith(("_", "."))] if self.version() else []

    # -- answers
    def stored(self) -> DataFrame:
        """All rows as they were added."""
        if not self.version():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.table(self._table(self.version()))

    def answers(self) -> DataFrame:
        """One row a key."""
        rows = self.stored()
        more = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.min(F.struct(*more)).alias("a")).select("key", "a.*")

    def missing(self, asked: DataFrame) -> DataFrame:
        """Rows of ``asked`` whose key has no answer."""
        return asked.repartition(self.buckets, "key").join(self.answers().select("key"), "key", "left_anti")

    def found(self, asked: DataFrame) -> DataFrame:
        """Rows of ``asked`` that have an answer, with it."""
        return asked.repartition(self.buckets, "key").join(self.answers(), "key")

    def add(self, rows: DataFrame) -> None:
        """Add answers; rows of a key that has one already change nothing."""
        if not self.version():
            self._put("_buckets", str(self.buckets))
            self._put("_current", "1")
        columns = [f.name for f in StructType.fromDDL(self.schema)]
        self._write(rows.select(*columns), self.version())
        if len(self.files()) > MOST_FILES * self.buckets:
            self.compact()

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(self._table(version))

    def compact(self) -> None:
        """Write the next version: one file a bucket, one row a key."""
        now = self.version()
        if not now:
            return
        self._fs.delete(self._jvm.Path(self._place(now + 1)), True)  # what a broken-off attempt has left
        self._write(self.answers(), now + 1)
        self._put("_current", str(now + 1))
        for n in self._names(self._root):
            late = int(n.removeprefix("_version-")) if n.startswith("_version-") else 1 if _BUCKETED.search(n) else now
            if late < now:
                self._fs.delete(self._jvm.Path(self._root, n), True)
