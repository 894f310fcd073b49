"""Tables that are replaced as a whole or not at all.

A write goes to a folder of its own and then becomes a row of the table's
manifest, which readers follow: rows below a folder that no manifest names do
not exist. A replacement names a new first folder, so a run that breaks off
anywhere leaves the old rows in place, and a reader that began before it goes on
reading the old folders. Old folders stay until `vacuum`.

The manifest grows by a row per write and is folded by the reader; it holds
folder names and counts, never data. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.sources.measured import measured_write

MANIFEST = "version long, folder string, replaces boolean, rows long"


class NoSuchVersion(ValueError):
    pass


class VersionedTable:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _manifest(self, spark: SparkSession) -> list:
        """All writes in order; one small row each."""
        path = f"{self.path}/_manifest"
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(path)
        return spark.read.schema(MANIFEST).parquet(path).orderBy("version", "folder").collect()

    def history(self, spark: SparkSession) -> DataFrame:
        self._manifest(spark)
        return spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifest")

    def write(self, df: DataFrame, replace: bool = False) -> int:
        """Append rows, or replace all; returns the new version. Rows are counted by the write itself."""
        spark = df.sparkSession
        version = max((r["version"] for r in self._manifest(spark)), default=-1) + 1
        folder = f"data-{version}-{uuid.uuid4().hex}"
        rows = measured_write(df, f"{self.path}/{folder}", {"rows": F.count(F.lit(1))})["rows"]
        self._commit(spark, version, folder, replace, rows)
        return version

    def _commit(self, spark: SparkSession, version: int, folder: str, replace: bool, rows: int) -> None:
        entry = spark.createDataFrame([(version, folder, replace, rows)], MANIFEST)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/_manifest")

    def live_folders(self, spark: SparkSession, version: int | None = None) -> list[str]:
        entries = self._manifest(spark)
        if version is not None:
            if version not in {r["version"] for r in entries}:
                raise NoSuchVersion(f"no version {version} of {self.path}")
            entries = [r for r in entries if r["version"] <= version]
        first = max((i for i, r in enumerate(entries) if r["replaces"]), default=0)
        return [f"{self.path}/{r['folder']}" for r in entries[first:]]

    def read(self, spark: SparkSession, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows of a version, the last if none is named, under the union of their columns.

        A table without writes needs a `schema` to be read.
        """
        folders = self.live_folders(spark, version)
        if not folders:
            if schema is None:
                raise NoSuchVersion(f"nothing was written to {self.path}")
            return spark.createDataFrame([], schema)
        if schema is not None:
            return spark.read.schema(schema).parquet(*folders)
        return spark.read.option("mergeSchema", "true").parquet(*folders)

    def vacuum(self, spark: SparkSession, keep: int = 1) -> list[str]:
        """Delete folders that none of the last `keep` versions needs, torn writes included; returns their names."""
        versions = sorted({r["version"] for r in self._manifest(spark)})[-max(keep, 1):]
        needed = {f.rsplit("/", 1)[1] for v in versions for f in self.live_folders(spark, v)}
        hadoop = spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        gone = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in needed:
                files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)
