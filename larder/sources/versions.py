"""Versioned Parquet tables (S15): rewrite, keep what was there, roll back.

A version is a folder of files that never changes, and a manifest that names it. Writing
makes the folder first; the version exists once its manifest has got its name, by one atomic
rename that fails if the name is taken. So a job that breaks off in between, or loses a race
against another writer, leaves the table as it was. Readers take a version's folder when they
start and keep it. Rolling back publishes an older folder as a new version; nothing is copied.

    <path>/data/<id>/part-*.parquet
    <path>/manifests/<number>.json
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer has published the next version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file(self.path).getFileSystem(self._conf)

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Numbers of the published versions, from old to new."""
        folder = self._file(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """folder, schema, number of rows and origin of a version; without a number, of the latest."""
        if version is None:
            known = self.versions()
            if not known:
                raise FileNotFoundError(f"{self.path} has no version")
            version = known[-1]
        stream = self._fs.open(self._file(f"{self.path}/manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Later versions don't change what this frame reads."""
        m = self.manifest(version)
        return self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{self.path}/{m['folder']}")

    def stage(self, df: DataFrame) -> dict:
        """Write the files of a version that is not published yet; its manifest."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").count()  # from the files' metadata
        return {"folder": folder, "schema": json.loads(df.schema.json()), "rows": rows, "origin": "write"}

    def publish(self, manifest: dict, after: int | None = None) -> int:
        """Make ``manifest`` the version behind ``after`` (by default, the latest there is)."""
        known = self.versions()
        version = (after if after is not None else known[-1] if known else 0) + 1
        self._fs.mkdirs(self._file(f"{self.path}/manifests"))
        draft = self._file(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._file(f"{self.path}/manifests/{version}.json")), kinds)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._file(f"{self.path}/manifests/{version}.json")):
                raise VersionConflict(f"version {version} of {self.path} exists") from e
            raise
        return version

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Publish the rows of ``df``, which may read an earlier version of this table. With ``after``,
        only if that is still the latest version."""
        return self.publish(self.stage(df), after)

    def rollback(self, version: int) -> int:
        """Publish an older version's files as the latest version."""
        return self.publish(self.manifest(version) | {"origin": f"rollback to {version}"})
