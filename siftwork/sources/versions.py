"""A table in a folder that is replaced in whole steps: staged data, one manifest a version, rollback.

Rows are dealt to BUCKETS parts by a hash of their key columns. A replacement writes the buckets that its keys fall in to
a new data folder, the rows of other keys in them included; the other buckets are not touched. A manifest then names the
data folder of each bucket. It is written beside its final name and renamed to it, which fails if the name exists, so a
version is there as a whole or not at all, and of two writers that start from one version the second fails. Data of a
job that failed is in no manifest; nothing reads it. Old versions stay readable until vacuum().

Edge cases: a table without a version reads as an empty one; a null key is a key; rows that repeat a key all stay;
replacing with no rows adds a version that is like the one before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32


class VersionConflict(RuntimeError):
    """Another writer has made this version."""


@dataclass
class VersionedTable:
    """The table in root with the columns of schema; keys: the columns by which rows are replaced."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: list[str]

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all versions, ascending."""
        fs, folder = self._files(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict[str, str]:
        """The data folder of each bucket that has rows."""
        if not version:
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(str(self._path(f"manifests/{version:08}.json"))).first()[0])

    def _point(self, version: int, buckets: dict[str, str]) -> int:
        jvm, fs = self.spark.sparkContext._jvm, self._files()
        staged, final = self._path(f"staged/{uuid.uuid4().hex}"), self._path(f"manifests/{version:08}.json")
        out = fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(buckets, sort_keys=True).encode()))
        finally:
            out.close()
        fs.mkdirs(final.getParent())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(final), options)
        except Exception as error:
            if fs.exists(final):
                raise VersionConflict(f"version {version} exists") from error
            raise
        return version

    def _read(self, buckets: dict[str, str]) -> DataFrame:
        paths = [str(self._path(f"data/{folder}/_bucket={k}")) for k, folder in buckets.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        return self._read(self._manifest(version if version is not None else (known or [0])[-1]))

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """A new version without the rows of the keys in rows (and in gone, a table of keys), and with rows; its number."""
        last = (self.versions() or [0])[-1]
        now, bucket = self._manifest(last), F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")
        asked = rows.select(*self.keys) if gone is None else rows.select(*self.keys).unionByName(gone.select(*self.keys))
        touched = {str(r[0]) for r in asked.select(bucket).distinct().collect()}  # at most BUCKETS
        old, left = self._read({k: f for k, f in now.items() if k in touched}), asked.distinct()
        same = F.lit(True)
        for k in self.keys:
            same = same & old[k].eqNullSafe(left[k])
        folder = f"{last + 1:08}-{uuid.uuid4().hex}"
        out = old.join(left, same, "left_anti").unionByName(rows.select(*self.schema.names)).withColumn("_bucket", bucket)
        out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(str(self._path(f"data/{folder}")))
        fs, written = self._files(), {s.getPath().getName() for s in self._files().listStatus(self._path(f"data/{folder}"))}
        fresh = {k: folder for k in touched if f"_bucket={k}" in written}
        return self._point(last + 1, {k: f for k, f in now.items() if k not in touched} | fresh)

    def rollback(self, version: int) -> int:
        """A new version that is what an old one was; its number."""
        known = self.versions()
        if version not in known:
            raise ValueError(f"there is no version {version}")
        return self._point(known[-1] + 1, self._manifest(version))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last versions, and data that none of those names; the number of deleted data folders.

        For times without writers: what a running job has staged would go as well.
        """
        fs, known = self._files(), self.versions()
        used = {f for v in known[-keep:] for f in self._manifest(v).values()}
        for v in known[:-keep]:
            fs.delete(self._path(f"manifests/{v:08}.json"), False)
        data = [s.getPath().getName() for s in fs.listStatus(self._path("data"))] if fs.exists(self._path("data")) else []
        for name in set(data) - used:
            fs.delete(self._path(f"data/{name}"), True)
        return len(set(data) - used)
