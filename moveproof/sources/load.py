"""Loading a folder of CSV and JSON files into tables."""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moveproof.functions.names import table_target
from moveproof.operators import shape
from moveproof.operators.profile import union_all
from moveproof.session import literal_rows, scratch_dir, stored
from moveproof.sources import readers, writers
from moveproof.sources.measured import measured_write

HISTORY = (
    "run_ts string, file string, digest string, table string, load string, mode string, "
    "rows_inserted long, rows_rejected long, status string, error string"
)
#: What Spark raises for input that it cannot read.
UNREADABLE = (PySparkException, Py4JJavaError)
#: What a malformed JSON line leaves behind.
CORRUPT = "_corrupt_record"
#: Files of one load that are counted by the writing tasks; more of them are grouped in a pass of their own.
OBSERVED_FILES = 64


def _history(spark: SparkSession, target: str) -> DataFrame:
    """The load history, started empty when there is none."""
    path = f"{target}/_history"
    spark.createDataFrame([], HISTORY).write.mode("ignore").parquet(path)
    return spark.read.schema(HISTORY).parquet(path)


def ingest(
    spark: SparkSession,
    folder: str,
    target: str,
    run_ts: str,
    mode: str = "skip",
    strict: bool = False,
    table_names: dict[str, str] | None = None,
    column_mapping: dict | None = None,
    types: dict[str, dict[str, str]] | None = None,
    required: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Load every new file of a folder into `target/<table>`; returns this run's history rows.

    A file loads as a whole or not at all: rows of a file with a value or a
    line that does not fit go to `target/_quarantine/<table>` with their
    error, and a file that cannot be read is recorded as FAILED; the others load.
    Files of other kinds are recorded as UNSUPPORTED. `skip` leaves out files
    whose name and content loaded before, `force` loads them again, `reload`
    replaces the table.

    A load writes folders named by its files' content, and the history last: a run
    that broke off has no history, leaves nothing that `read_loaded` shows, and
    repeating it writes the same folders again. The files of a table are read
    together, grouped by layout. The driver sees file and column names and one
    history row per file, never data. `target` must be shared storage.
    """
    writers.check_mode(mode)
    history = _history(spark, target)
    files = writers.file_digests(spark, folder)
    if mode == "skip":
        done = history.filter("status IN ('SUCCESS', 'UNSUPPORTED')").withColumn("status", F.lit("SUCCESS"))
        files = writers.unprocessed(files, done)
    stem = F.regexp_replace("file", r"\.[^.]+$", "")
    supported = F.lower("file").rlike(r"\.(csv|json)$")
    found = files.withColumns({
        "table": table_target(stem, table_names or {}), "supported": supported}).orderBy("file").collect()
    known = {r["table"] for r in
             history.filter("status = 'SUCCESS'").select("table").distinct().collect()}
    by_table: dict[str, list] = {}
    for row in found:
        if row["supported"]:
            by_table.setdefault(row["table"], []).append(row)
    done = [
        _load_apart(
            spark, folder, target, name, rows, run_ts, mode, strict, name in known,
            column_mapping or {}, (types or {}).get(name, {}), (required or {}).get(name, []),
        )
        for name, rows in by_table.items()
    ]
    other = [r for r in found if not r["supported"]]
    if other:
        done.append(_not_loaded(spark, other, None, run_ts, mode, "UNSUPPORTED", "UNSUPPORTED_FILE"))
    if not done:
        return history.limit(0)
    result = stored(union_all(done), "load-result")
    result.coalesce(1).write.mode("append").parquet(f"{target}/_history")
    return result


def _not_loaded(spark, rows, name, run_ts, mode, status, error) -> DataFrame:
    return literal_rows(spark, HISTORY, [
        (run_ts, r["file"], r["digest"], name, None, mode, 0, 0, status, error) for r in rows])


def _load_apart(spark, folder, target, name, rows, run_ts, mode, strict, exists, *rest) -> DataFrame:
    """The files of a table together; if Spark cannot read them, one by one, so that one bad file fails alone."""
    try:
        return _load_table(spark, folder, target, name, rows, run_ts, mode, strict, exists, *rest)
    except (*UNREADABLE, ValueError) as failure:
        if len(rows) == 1 or isinstance(failure, shape.StrictSchemaError):
            return _not_loaded(spark, rows, name, run_ts, mode, "FAILED", str(failure)[:500])
    parts, later = [], mode
    for row in rows:
        part = _load_apart(spark, folder, target, name, [row], run_ts, later, strict, exists, *rest)
        parts.append(part)
        if later == "reload" and part.filter("status = 'SUCCESS'").count():
            later = "force"  # the first good file replaces the table, the others join it
    return union_all(parts)


def _read_files(spark, folder, rows) -> list[DataFrame]:
    """A table's files by layout, with `_file`; a malformed JSON line stays in `_corrupt_record`."""
    paths = {kind: [f"{folder.rstrip('/')}/{r['file']}" for r in rows if r["file"].lower().endswith(kind)]
             for kind in readers.SUPPORTED}
    frames = []
    if paths[".csv"]:
        frames += readers.csv_groups(spark, paths[".csv"], file_column="_file")
    if paths[".json"]:
        try:
            frames.append(_checked_json(spark, paths[".json"]))
        except UNREADABLE:
            frames.append(readers.read_json(
                spark, paths[".json"], bad_lines="keep", file_column="_file"))
    return frames


def _checked_json(spark, paths) -> DataFrame:
    """Well-formed files; the first malformed line raises."""
    return stored(readers.read_json(spark, paths, file_column="_file"), "json-rows")


def _load_table(
    spark, folder, target, name, rows, run_ts, mode, strict, exists, mapping, types, required
) -> DataFrame:
    key = "|".join([run_ts, *(f"{r['file']}:{r['digest']}" for r in rows)])
    load = hashlib.sha256(key.encode()).hexdigest()[:24]
    listed = literal_rows(
        spark, "file string, digest string", [(r["file"], r["digest"]) for r in rows]
    )
    frames = []
    for raw in _read_files(spark, folder, rows):
        data = raw.drop("_file", CORRUPT)
        names = shape.mapped_names(data, **mapping)
        kept = [F.col(c) for c in ("_file", CORRUPT) if c in raw.columns]
        frames.append(raw.select(*[F.col(f"`{c}`").alias(t) for c, t in names.items()], *kept))
    incoming = union_all(frames)
    data = incoming.drop("_file", CORRUPT)
    if strict:
        current = read_loaded(spark, target, name) if exists else None
        shape.evolve(current, data, strict=True)
    held = {c: t for c, t in types.items() if c in data.columns}
    absent = [c for c in required if c not in data.columns]
    checked = shape.quarantine(incoming, held, [c for c in required if c not in absent])
    if absent:
        checked = checked.withColumn("error", F.lit(f"missing columns: {', '.join(absent)}"))
    if CORRUPT in incoming.columns:
        checked = checked.withColumn("error", F.when(F.col(CORRUPT).isNotNull(), "malformed line")
                                     .otherwise(F.col("error")))
    checked, counts = _checked_and_counted(checked, [r["file"] for r in rows], name, run_ts)
    good = counts.filter("status = 'SUCCESS'").select(F.col("file").alias("_file"))
    bad = counts.filter("status = 'FAILED'").select(F.col("file").alias("_file"))
    loaded = checked.join(good, "_file", "left_semi").select(*[F.col(f"`{c}`") for c in data.columns])
    shape.typed(loaded, held).write.mode("overwrite").parquet(f"{target}/{name}/load={load}")
    shown = [c for c in checked.columns if c not in ("_file", "error")]
    checked.join(bad, "_file", "left_semi").select(
        "_file", "error", F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown])).alias("row"),
        F.lit(run_ts).alias("run_ts"),
    ).write.mode("overwrite").parquet(f"{target}/_quarantine/{name}/load={load}")
    status = F.coalesce("status", F.lit("SUCCESS"))  # a file without rows loads nothing, well
    return listed.join(counts, "file", "left").select(
        F.lit(run_ts).alias("run_ts"), "file", "digest", F.lit(name).alias("table"),
        F.lit(load).alias("load"), F.lit(mode).alias("mode"),
        F.coalesce("rows_inserted", F.lit(0)).cast("long").alias("rows_inserted"),
        F.coalesce("rows_rejected", F.lit(0)).cast("long").alias("rows_rejected"),
        status.alias("status"),
        F.when(status == "FAILED", "rows do not fit").alias("error"),
    )


def _checked_and_counted(checked: DataFrame, files: list[str], name: str, run_ts: str) -> tuple[DataFrame, DataFrame]:
    """The checked rows, parsed once and stored for both sinks, and good and bad rows of each file.

    The job that stores them counts them, so they are not read again for it.
    """
    spark = checked.sparkSession
    if len(files) > OBSERVED_FILES:
        checked = stored(checked, "checked")
        return checked, stored(
            writers.load_history(checked, "_file", name, run_ts).drop("timestamp"), "load-counts")
    path, good = scratch_dir(spark, "checked"), F.col("error").isNull()
    found = measured_write(checked, path, {
        f"{kind}{i}": F.count_if((F.col("_file") == file) & (good if kind == "good" else ~good))
        for i, file in enumerate(files) for kind in ("good", "bad")})
    counts = [(file, found[f"good{i}"], found[f"bad{i}"]) for i, file in enumerate(files)]
    return spark.read.schema(checked.schema).parquet(path), literal_rows(
        spark, "file string, table string, rows_inserted long, rows_rejected long, status string",
        [(file, name, 0 if bad else good, bad, "FAILED" if bad else "SUCCESS") for file, good, bad in counts if good + bad])


def read_loaded(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A loaded table under the union of all columns its loads brought.

    Shown are the loads that the history names, from the last `reload` on.
    """
    loads = _history(spark, target).filter(
        (F.col("table") == table) & F.col("load").isNotNull()
    ).groupBy("load").agg(
        F.min("run_ts").alias("run_ts"), F.bool_or((F.col("mode") == "reload") & (F.col("status") == "SUCCESS"))
        .alias("replaces")).orderBy("run_ts", "load").collect()  # one row per load
    last = max((r["run_ts"] for r in loads if r["replaces"]), default="")
    paths = [f"{target}/{table}/load={r['load']}" for r in loads if r["run_ts"] >= last]
    return spark.read.option("mergeSchema", "true").parquet(*paths)
