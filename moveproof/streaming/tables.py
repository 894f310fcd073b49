"""Streaming ingest, keyed change apply, per-batch profiling and drift.

Every sink writes the rows of a micro-batch under `batch=<id>` and overwrites
that folder when the batch is replayed, so a restart after a lost driver or
executor neither loses nor doubles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.functions.names import strip
from moveproof.operators.drift import column_changes
from moveproof.operators.profile import duplicate_rows, profile_columns, profiling_issues
from moveproof.operators.profile_state import STATE, column_states, merged_states, state_profile
from moveproof.operators.shape import quarantine, typed
from moveproof.operators.snapshot import change_status
from moveproof.session import literal_rows
from moveproof.sources.writers import load_history


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json",
    files_per_batch: int | None = None, archive: str | None = None,
) -> DataFrame:
    """New files of a folder, each read once; finished files move to `archive` if given."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def run_available(stream: DataFrame, checkpoint: str, apply) -> None:
    """Process everything there is, batch by batch, and stop; reruns continue from the checkpoint."""
    query = (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest_files(
    stream: DataFrame, path: str, checkpoint: str, types: dict[str, str], run_ts: str,
    required: list[str] = (),
) -> None:
    """Typed good rows to `path/data`, bad rows to `path/quarantine`, one history row per file."""
    tagged = stream.withColumn(
        "source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        checked = quarantine(batch, types, list(required)).persist()  # read by three writes
        good = checked.filter(F.col("error").isNull()).drop("error")
        _write_batch(typed(good, types), f"{path}/data", batch_id)
        _write_batch(checked.filter(F.col("error").isNotNull()), f"{path}/quarantine", batch_id)
        _write_batch(
            load_history(checked, "source_file", "data", run_ts), f"{path}/history", batch_id
        )
        checked.unpersist()

    run_available(tagged, checkpoint, apply)


BUCKETS = 16
#: Batches after which a change table folds its log into a new base.
COMPACT_EVERY = 20
BASE = "version long"


class ChangeTable:
    """A keyed table kept as change batches; reading folds them to the last row per key.

    A batch writes only its own changes, deletions as tombstones, under folders
    by a hash of the key, so that the state of some keys is read from their
    buckets alone. Every `compact_every` batches the log so far is folded into a new
    base, tombstones included, and later reads start from it, so a batch costs
    no more the longer the stream runs. A base is named in a list when it is complete; a
    replayed batch starts from the bases before it. `order` names columns that
    say which row of a key is later; without them the later batch wins.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str],
        order: list[str] = (), buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY,
    ):
        self.path, self.keys, self.order = path, keys, list(order)
        self.buckets, self.compact_every = buckets, compact_every
        self.fields = [f.name for f in schema.fields]
        self.schema = T.StructType(
            schema.fields + [T.StructField("is_deleted", T.BooleanType())]
        )
        spark.createDataFrame([], BASE).write.mode("ignore").parquet(f"{path}/bases")
        empty = spark.createDataFrame([], self.schema).withColumn("key_bucket", F.lit(0))
        empty.write.mode("ignore").partitionBy("key_bucket").parquet(f"{path}/log/batch=-1")

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        held = rows.select(*self.fields, "is_deleted", self._bucket().alias("key_bucket"))
        held.repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(path)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._write(rows, f"{self.path}/log/batch={batch_id}")

    def last_rows(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row per key, tombstones included; equal positions are settled by the values."""
        rest = [c for c in [*self.fields, "is_deleted"] if c not in self.keys]
        last = F.max(F.struct(*[F.col(c) for c in order], *[
            F.col(c) for c in rest if c not in order])).alias("last")
        return rows.groupBy(*self.keys).agg(last).select(
            *[F.col(c) if c in self.keys else F.col(f"last.{c}").alias(c) for c in self.fields],
            F.col("last.is_deleted").alias("is_deleted"),
        )

    def _folded(self, spark: SparkSession, before: int | None, only: DataFrame | None) -> DataFrame:
        bases = spark.read.schema(BASE).parquet(f"{self.path}/bases")
        if before is not None:
            bases = bases.filter(F.col("version") <= before)
        base = bases.agg(F.max("version")).first()[0]
        layout = T.StructType([*self.schema.fields, T.StructField("key_bucket", T.IntegerType()),
                               T.StructField("batch", T.LongType())])
        log = spark.read.schema(layout).option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        log = log.filter(F.col("batch") >= (base or 0))
        if before is not None:
            log = log.filter(F.col("batch") < before)
        rows = log
        if base is not None:
            held = T.StructType(layout.fields[:-1])
            rows = rows.unionByName(spark.read.schema(held).parquet(f"{self.path}/base-{base}")
                                    .withColumn("batch", F.lit(-1).cast("long")))
        if only is not None:  # before folding, so other keys are never shuffled
            touched = [r[0] for r in only.select(self._bucket()).distinct().collect()]  # bucket numbers
            rows = rows.filter(F.col("key_bucket").isin(touched)).join(only, self.keys, "left_semi")
        return self.last_rows(rows, [*self.order, "batch"])

    def read(
        self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None
    ) -> DataFrame:
        """Current rows, or the state that batches below `before` left, of some keys only."""
        return self._folded(spark, before, only).filter(~F.col("is_deleted")).select(*self.fields)

    def fold(self, spark: SparkSession, before: int) -> None:
        """A new base of all batches below `before`; the log stays for replays."""
        self._write(self._folded(spark, before, None), f"{self.path}/base-{before}")
        spark.createDataFrame([(before,)], BASE).write.mode("append").parquet(f"{self.path}/bases")

    def compact(self, spark: SparkSession, target: str) -> "ChangeTable":
        """The folded state, without tombstones, as the first batch of a fresh table."""
        out = ChangeTable(
            spark, target, T.StructType(self.schema.fields[:-1]), self.keys, self.order,
            self.buckets, self.compact_every)
        out.write(self.read(spark).withColumn("is_deleted", F.lit(False)), 0)
        return out


def apply_changes(
    stream: DataFrame, table: ChangeTable, checkpoint: str, deleted: str | None = None
) -> None:
    """Insert new keys, replace changed ones, mark deleted ones; unchanged rows write nothing.

    A batch row with `deleted` true is a tombstone. Several rows of one key in
    a batch count as the last of them. The batch is compared with the state of
    all earlier batches, also on replay.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        flag = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        tagged = batch.withColumn("is_deleted", flag).select(*table.fields, "is_deleted")
        rows = table.last_rows(tagged, table.order).persist()
        stored = table.read(batch.sparkSession, batch_id, rows.select(*table.keys)).persist()
        live = rows.filter(~F.col("is_deleted"))
        changed = change_status(stored, live, table.keys).filter(
            F.col("change_status").isin("NEW", "CHANGED")
        ).select(*table.keys)
        upserts = live.join(changed, table.keys, "left_semi")
        tombstones = rows.filter("is_deleted").join(stored, table.keys, "left_semi")
        table.write(upserts.unionByName(tombstones), batch_id)
        if batch_id and batch_id % table.compact_every == 0:
            table.fold(batch.sparkSession, batch_id)
        stored.unpersist()
        rows.unpersist()

    run_available(stream, checkpoint, apply)


def profile_batches(
    stream: DataFrame, dataset: str, path: str, checkpoint: str, semantics: DataFrame | None = None
) -> None:
    """Column metrics and findings of every batch, appended to the metrics tables."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # the batch is scanned for columns and for duplicates
        columns = profile_columns({dataset: held})
        duplicates = duplicate_rows({dataset: held})
        _write_batch(columns, f"{path}/columns", batch_id)
        _write_batch(profiling_issues(columns, duplicates, semantics), f"{path}/issues", batch_id)
        held.unpersist()

    run_available(stream, checkpoint, apply)


class ProfileStates:
    """The profile of a growing table as states of its batches, merged when read.

    Every `compact_every` batches the states so far become one, so reading costs no
    more the longer the stream runs; a replayed batch overwrites its own state and
    starts from the merged states before it.
    """

    def __init__(self, path: str, dataset: str, compact_every: int = COMPACT_EVERY):
        self.path, self.dataset, self.compact_every = path, dataset, compact_every

    def states(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The last merged state and the states of the batches since."""
        layout = STATE + ", batch long"
        merged = spark.read.schema(layout).parquet(f"{self.path}/merged")
        if before is not None:
            merged = merged.filter(F.col("batch") <= before)
        base = merged.agg(F.max("batch")).first()[0]
        rows = spark.read.schema(layout).parquet(f"{self.path}/states").filter(F.col("batch") >= (base or 0))
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        if base is not None:
            rows = rows.unionByName(merged.filter(F.col("batch") == base))
        return rows.drop("batch")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:  # so that the folder can be read before anything is merged
            spark.createDataFrame([], STATE).write.mode("ignore").parquet(f"{self.path}/merged/batch=-1")
        _write_batch(column_states({self.dataset: batch}), f"{self.path}/states", batch_id)
        if batch_id and batch_id % self.compact_every == 0:
            _write_batch(merged_states(self.states(spark, batch_id)).coalesce(1), f"{self.path}/merged", batch_id)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        run_available(stream, checkpoint, self.apply)

    def profile(self, spark: SparkSession, database: str = "source") -> DataFrame:
        return state_profile(self.states(spark), database)


def drift_batches(
    stream: DataFrame, table: str, document: str, path: str, checkpoint: str,
    registry: list[str], evolve: bool = True,
) -> None:
    """Keys of each batch's JSON documents against the registry of all earlier batches, a row per change.

    With `evolve` new keys join the registry and all rows pass; without it
    rows that carry unknown keys are quarantined and the registry stays.
    """
    schema = "table string, column string"
    seed = literal_rows(stream.sparkSession, schema, [(table, c) for c in registry])
    seed.write.mode("ignore").parquet(f"{path}/columns/batch=-1")

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = batch_id if evolve else 0
        known = _earlier(batch.sparkSession, f"{path}/columns", before, seed.schema)
        keys = F.json_object_keys(F.col(document))
        seen = batch.select(F.explode(keys).alias("column")).distinct().select(
            F.lit(table).alias("table"), "column"
        )
        changes = column_changes(known, seen).persist()  # read by both writes
        _write_batch(changes, f"{path}/drift", batch_id)
        new = changes.filter(F.col("change") == "ADDED").select("table", F.col("column").alias("folded"))
        folded = seen.withColumn("folded", F.lower(strip(F.col("column"))))
        _write_batch(folded.join(new, ["table", "folded"], "left_semi").select("table", "column"),
                     f"{path}/columns", batch_id)  # the registry grows by new columns only
        changes.unpersist()
        if evolve:
            _write_batch(batch, f"{path}/rows", batch_id)
            return
        unknown = F.size(F.array_except(keys, F.array(*[F.lit(c) for c in registry]))) > 0
        strange = F.coalesce(unknown, F.lit(False))
        _write_batch(batch.filter(~strange), f"{path}/rows", batch_id)
        _write_batch(batch.filter(strange), f"{path}/quarantine", batch_id)

    run_available(stream, checkpoint, apply)


def _earlier(
    spark: SparkSession, path: str, before: int | None, schema: T.StructType,
    keep_batch: bool = False,
) -> DataFrame:
    """Rows of the batches below `before`; only their folders are listed and read."""
    layout = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    rows = spark.read.schema(layout).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows if keep_batch else rows.select(*schema.names)
