"""Aggregated copies that are kept up to date from a change log instead of being computed anew.

A group's row holds how many rows it stands for, and of each measure the sum and how many values it is of. A
change retracts the row it replaces and adds the new one; deltas are summed per
group before anything is read, and a group whose count falls to 0 goes. State lies
in buckets by a hash of the group. A refresh reads and writes only the
buckets its deltas touch, as a version of its own, and then names them in the
manifest, so a refresh that breaks off changes nothing and repeating it gives
the same. Measures are whole numbers or decimals, since sums of reals would depend
on the order in which they were added and retracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.streaming.tables import BUCKETS, ChangeTable

MANIFEST = "version long, bucket int"


class AggregateView:
    """Counts and sums of `measures` of a `ChangeTable`'s rows by `groups`."""

    def __init__(self, source: ChangeTable, path: str, groups: list[str], measures: list[str], buckets: int = BUCKETS):
        self.source, self.path, self.groups, self.measures = source, path.rstrip("/"), groups, measures
        self.buckets = buckets
        types = {f.name: f.dataType for f in source.schema.fields}
        for m in measures:
            if not isinstance(types[m], (T.IntegralType, T.DecimalType)):
                raise ValueError(f"{m} is {types[m].simpleString()}; sums are kept of whole numbers and decimals")
        self.schema = T.StructType(
            [T.StructField(g, types[g]) for g in groups] + [T.StructField("n_rows", T.LongType())]
            + [T.StructField(f"sum_{m}", T.DecimalType(38, getattr(types[m], "scale", 0))) for m in measures]
            + [T.StructField(f"filled_{m}", T.LongType()) for m in measures])

    def _manifest(self, spark: SparkSession) -> DataFrame:
        path = f"{self.path}/manifest"
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(path)
        return spark.read.schema(MANIFEST).parquet(path)

    def _state(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """The last version of each bucket; other folders are not opened."""
        live = self._manifest(spark).groupBy("bucket").agg(F.max("version").alias("version")).collect()
        base = f"{self.path}/state"
        paths = [f"{base}/version={r['version']}/bucket={r['bucket']}" for r in live if only is None or r["bucket"] in only]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def _deltas(self, rows: DataFrame) -> DataFrame:
        sums = [F.sum((F.col(f"`{m}`") * F.col("_weight")).cast(self.schema[f"sum_{m}"].dataType)).alias(f"sum_{m}")
                for m in self.measures]
        sums += [F.sum(F.when(F.col(f"`{m}`").isNotNull(), F.col("_weight")).otherwise(0)).cast("long").alias(f"filled_{m}")
                 for m in self.measures]
        return rows.groupBy(*self.groups).agg(F.sum("_weight").cast("long").alias("n_rows"), *sums)

    def version(self, spark: SparkSession) -> int:
        """The last batch of the log that the view knows, -1 before the first."""
        last = self._manifest(spark).agg(F.max("version")).first()[0]
        return -1 if last is None else last

    def refresh(self, spark: SparkSession) -> list[int]:
        """Take up the batches that came since; returns the buckets that were read and written."""
        since = self.version(spark)
        layout = T.StructType([*self.source.schema.fields, T.StructField("key_bucket", T.IntegerType()),
                               T.StructField("batch", T.LongType())])
        log = f"{self.source.path}/log"
        fresh = spark.read.schema(layout).option("basePath", log).parquet(log).filter(F.col("batch") > since)
        until = fresh.agg(F.max("batch")).first()[0]
        if until is None:
            return []
        keys = fresh.select(*self.source.keys).distinct()
        gone = self.source.read(spark, since + 1, keys) if since >= 0 else None
        rows = self.source.read(spark, until + 1, keys).withColumn("_weight", F.lit(1))
        if gone is not None:
            rows = rows.unionByName(gone.withColumn("_weight", F.lit(-1)))
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{g}`") for g in self.groups]), F.lit(self.buckets)).cast("int")
        moved = F.col("n_rows") != 0  # a sum of nulls alone is null, and nothing moves it
        for m in self.measures:
            moved = moved | F.coalesce(F.col(f"sum_{m}") != 0, F.lit(False)) | (F.col(f"filled_{m}") != 0)
        deltas = self._deltas(rows).filter(moved).withColumn("bucket", bucket).persist()
        touched = sorted(r["bucket"] for r in deltas.select("bucket").distinct().collect())  # numbers below `buckets`
        names = [f.name for f in self.schema.fields]
        summed = self._state(spark, touched).unionByName(deltas.select(*names)).groupBy(*self.groups).agg(
            *[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in names if c not in self.groups])
        held = summed.filter("n_rows <> 0").withColumn("bucket", bucket)
        path = f"{self.path}/state/version={until}"
        held.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        placed = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        present = {r["bucket"] for r in spark.read.schema(placed).parquet(path).select("bucket").distinct().collect()}
        for b in touched:
            if b not in present:  # emptied: a folder without rows
                spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{path}/bucket={b}")
        entries = [(until, b) for b in touched] or [(until, -1)]
        if not touched:
            spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{path}/bucket=-1")
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        deltas.unpersist()
        return touched

    def read(self, spark: SparkSession) -> DataFrame:
        """The groups; a sum is null if all values of a group are."""
        sums = [F.when(F.col(f"filled_{m}") > 0, F.col(f"sum_{m}")).alias(f"sum_{m}") for m in self.measures]
        return self._state(spark).select(*self.groups, "n_rows", *sums)
