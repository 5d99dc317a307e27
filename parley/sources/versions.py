"""Versioned data sets: a version is a manifest of files that never change, so cloning one copies no row.

Below the data set's folder lie data/<id> (files of rows, by bucket of their key) and versions/<number> (manifests:
bucket and data folder, with the version's parent). A change writes the buckets that it touches anew and names them in
the manifest of its own version; older versions keep naming what they named.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, data string, parent int, frozen boolean"


class Frozen(ValueError):
    """A version that may not change any more."""


class VersionedSet:
    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType | str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path = self._hadoop.Path(f"{self.folder}/versions")
        if not self._files.exists(path):
            return []
        return sorted(int(x.getPath().getName()) for x in self._files.listStatus(path) if x.getPath().getName().isdigit())

    def _manifest(self, version: int) -> list[Any]:
        """One row a bucket, and one without a bucket that holds for the version."""
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/versions/{version}").collect()

    def _commit(self, version: int, rows: list[tuple]) -> int:
        """Write the manifest aside and move it to its number; a number that another writer took meanwhile is refused."""
        aside = f"{self.folder}/_aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(aside)
        target = self._hadoop.Path(f"{self.folder}/versions/{version}")
        self._files.mkdirs(target.getParent())
        if self._files.exists(target) or not self._files.rename(self._hadoop.Path(aside), target):
            self._files.delete(self._hadoop.Path(aside), True)
            raise ValueError(f"version {version} exists already")
        return version

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        """Rows as files by bucket: (data folder, buckets that have rows)."""
        data = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")
        # Buckets are dealt by bucket, so each has few files; adaptive execution splits large ones.
        rows.select(*self.schema.names, bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{data}")
        root = self._hadoop.Path(f"{self.folder}/{data}")
        names = [x.getPath().getName() for x in self._files.listStatus(root)]
        return data, {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}

    def create(self, rows: DataFrame) -> int:
        """Rows as the next version, without a parent."""
        data, buckets = self._write(rows)
        return self._commit(max(self.versions(), default=0) + 1, [(None, None, None, False), *((b, data, None, None) for b in sorted(buckets))])

    def clone(self, version: int) -> int:
        """The next version, with the files of `version`, which becomes its parent. No row is read or written."""
        rows = [(r.bucket, r.data, None, None) for r in self._manifest(version) if r.bucket is not None]
        return self._commit(max(self.versions()) + 1, [(None, None, version, False), *rows])

    def read(self, version: int) -> DataFrame:
        """The rows of a version, from the folders that its manifest names."""
        rows = [r for r in self._manifest(version) if r.bucket is not None]
        paths = [f"{self.folder}/{r.data}/_bucket={r.bucket}" for r in rows]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def parent(self, version: int) -> int | None:
        return next(r.parent for r in self._manifest(version) if r.bucket is None)

    def frozen(self, version: int) -> bool:
        return next(bool(r.frozen) for r in self._manifest(version) if r.bucket is None)

    def freeze(self, version: int) -> None:
        """From now on the version can't change; it can be cloned."""
        rows = [(r.bucket, r.data, r.parent, True if r.bucket is None else None) for r in self._manifest(version)]
        self._replace(version, rows)

    def _replace(self, version: int, rows: list[tuple]) -> None:
        target = self._hadoop.Path(f"{self.folder}/versions/{version}")
        aside, old = (self._hadoop.Path(f"{self.folder}/_aside/{uuid.uuid4().hex}") for _ in range(2))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(aside.toString())
        self._files.mkdirs(old.getParent())
        self._files.rename(target, old)
        self._files.rename(aside, target)
        self._files.delete(old, True)

    def change(self, version: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Replace or add rows by key, then delete keys, in one version. Only buckets with a changed key are written anew;
        files that other versions name stay as they are. Upserts are distinct by key; null keys are not changed."""
        if self.frozen(version):
            raise Frozen(f"version {version} is frozen")
        rows = [r for r in self._manifest(version) if r.bucket is not None]
        keys = [x.select(self.key) for x in (upserts, deletes) if x is not None]
        if not keys:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        changed = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
        touched = {r[0] for r in changed.where(F.col(self.key).isNotNull()).select(bucket).distinct().collect()}  # buckets at most
        paths = [f"{self.folder}/{r.data}/_bucket={r.bucket}" for r in rows if r.bucket in touched]
        before = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        kept = before.join(changed.distinct(), self.key, "left_anti")
        if upserts is not None:
            added = upserts.select(*self.schema.names).where(F.col(self.key).isNotNull())
            kept = kept.unionByName(added if deletes is None else added.join(deletes.select(self.key).distinct(), self.key, "left_anti"))
        data, written = self._write(kept)
        after = [(r.bucket, r.data, None, None) for r in rows if r.bucket not in touched] + [(b, data, None, None) for b in sorted(written)]
        self._replace(version, [(None, None, self.parent(version), False), *after])
