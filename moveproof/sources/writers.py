"""Table and document sinks, load modes and load history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moveproof.sources.readers import file_name
from moveproof.sources.versioned import VersionedTable

LOAD_MODES = ("skip", "force", "reload")
JDBC_BATCH = 500


def check_mode(mode: str) -> str:
    if mode not in LOAD_MODES:
        raise ValueError(f"unknown load mode {mode!r}; expected one of {LOAD_MODES}")
    return mode


def unprocessed(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates (file, digest) without a successful load of the same name and content."""
    done = history.filter(F.col("status") == "SUCCESS").select("file", "digest")
    return candidates.join(done, ["file", "digest"], "left_anti")


def write_table(df: DataFrame, path: str, mode: str = "skip") -> None:
    """Append, or replace as a whole under 'reload'. Name and content checks come before this step."""
    VersionedTable(path).write(df, replace=check_mode(mode) == "reload")


def write_documents(df: DataFrame, path: str, schema_status: str) -> None:
    """Nested rows into a collection; a changed or shrunk schema replaces it, else append."""
    VersionedTable(path).write(df, replace=schema_status in ("CHANGED", "DELETED"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """What `write_table` and `write_documents` left; a write that broke off is not seen."""
    return VersionedTable(path).read(spark)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "skip", **properties) -> None:
    """The same load modes against a relational target, in batches of 500."""
    options = {"url": url, "dbtable": table, "batchsize": str(JDBC_BATCH), **properties}
    if check_mode(mode) == "reload":
        options["truncate"] = "true"
    df.write.format("jdbc").options(**options).mode(
        "overwrite" if mode == "reload" else "append"
    ).save()


def load_history(rows: DataFrame, by: str, table: str, run_ts: str) -> DataFrame:
    """One history record per loaded entity.

    Rows carry `error` (null when good); an entity fails as a whole when any
    of its rows does, and then counts no inserted rows.
    """
    bad = F.count_if(F.col("error").isNotNull())
    good = F.count_if(F.col("error").isNull())
    return rows.groupBy(F.col(by).alias("file")).agg(
        F.lit(run_ts).alias("timestamp"), F.lit(table).alias("table"),
        F.when(bad == 0, good).otherwise(0).cast("long").alias("rows_inserted"),
        bad.alias("rows_rejected"),
        F.when(bad == 0, "SUCCESS").otherwise("FAILED").alias("status"),
    )


def append_history(history: DataFrame, path: str) -> None:
    history.write.mode("append").json(path)


#: Lines that one digest covers; with it a digest's input stays bounded.
BLOCK_LINES = 1 << 16


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """file, digest: a digest of each file's bytes in their order, the same way for every size.

    Lines (cut at "\\n" only, so other bytes stay) are hashed where they are read
    and numbered through the file: within the piece of the file that a task reads,
    and by the sizes of the pieces before it. Blocks of `BLOCK_LINES` line hashes
    are digested in order, then the blocks' digests with the file's size, which
    tells whether the last line is closed and whether a byte order mark precedes the first.
    Spark lists no files without content, so they have no row.
    """
    name = file_name()
    lines = spark.read.text(folder, lineSep="\n").select(
        name.alias("file"), F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("at"), F.sha2(F.col("value").cast("binary"), 256).alias("hash"),
    )
    pieces = spark.read.text(folder, lineSep="\n").select(
        name.alias("file"), F.col("_metadata.file_block_start").alias("piece"),
    ).groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file", "piece").orderBy("at")) - 1
    numbered = lines.withColumn("inside", inside).join(starts, ["file", "piece"]).withColumn(
        "line", F.col("start") + F.col("inside"))
    blocks = numbered.groupBy("file", F.floor(F.col("line") / BLOCK_LINES).alias("block")).agg(
        _digest_in_order("line", "hash").alias("hash"))
    content = blocks.groupBy("file").agg(_digest_in_order("block", "hash").alias("content"))
    files = spark.read.format("binaryFile").load(folder).select(  # the content is not read
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")
    return files.join(content, "file", "left").select(
        "file", F.sha2(F.concat_ws(":", "length", "content"), 256).alias("digest"))


def _digest_in_order(order: str, value: str):
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x[value]), ""), 256)


VERSION = "version long"


class MaterializedView:
    """A stored copy of a frame's result: empty when new, replaced by each refresh.

    A refresh is written aside as a version of its own and then named in the list
    of versions, so readers see the old copy or the new one, and creating the
    object again keeps what is stored.
    """

    def __init__(self, source: DataFrame, path: str):
        self.source, self.path = source, path
        spark = source.sparkSession
        spark.createDataFrame([], VERSION).write.mode("ignore").parquet(f"{path}/versions")

    def _last(self) -> int:
        spark = self.source.sparkSession
        found = spark.read.schema(VERSION).parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def refresh(self) -> None:
        spark, version = self.source.sparkSession, self._last() + 1
        self.source.write.mode("overwrite").parquet(f"{self.path}/version-{version}")
        spark.createDataFrame([(version,)], VERSION).write.mode("append").parquet(f"{self.path}/versions")

    def read(self) -> DataFrame:
        last = self._last()
        if last < 0:
            return self.source.limit(0)
        spark = self.source.sparkSession
        return spark.read.schema(self.source.schema).parquet(f"{self.path}/version-{last}")
