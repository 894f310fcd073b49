"""Table and column profiling: nulls, distinct values, duplicates, issues, totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof import rules
from moveproof.functions.rates import grade, share
from moveproof.functions.text import comparable, hashable
from moveproof.functions.types import logical_type
from moveproof.operators.findings import as_findings
from moveproof.session import literal_rows, stored

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _slot(col: Column, dtype: T.DataType, utc: bool) -> tuple[str, Column]:
    """The value as a whole number, a real or text, whichever holds it exactly.

    Numbers, dates and timestamps stay eight bytes wide instead of being
    printed, and grouping reals treats 0.0 and -0.0 as one value. Zoneless
    timestamps are numbers only under UTC, where no two of them merge.
    """
    if isinstance(dtype, (*_WHOLE, T.BooleanType)):
        return "whole", col.cast("long")
    if isinstance(dtype, T.DateType):
        return "whole", F.unix_date(col).cast("long")
    if isinstance(dtype, T.TimestampType) or (utc and isinstance(dtype, T.TimestampNTZType)):
        return "whole", F.unix_micros(col.cast("timestamp"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real", comparable(col, dtype).cast("double")
    return "text", comparable(col, dtype).cast("string")


def _cells(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """(id, value) rows, one frame per kind of value; a missing value is null.

    `id` numbers the columns of all frames in order. Each frame reads only its
    own columns, so the frames together read every column once, and long texts
    do not share a hash table with numbers.
    """
    first = 0
    by_kind: dict[str, list[DataFrame]] = {"whole": [], "real": [], "text": []}
    for name, df in frames.items():
        utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT")
        columns: dict[str, list[Column]] = {}
        for i, f in enumerate(df.schema.fields):
            kind, value = _slot(F.col(f"`{f.name}`"), f.dataType, utc)
            cell = F.struct(F.lit(first + i).alias("id"), value.alias("value"))
            columns.setdefault(kind, []).append(cell)
        for kind, cells in columns.items():
            by_kind[kind].append(df.select(F.inline(F.array(*cells))))
        first += len(df.columns)
    return [union_all(parts) for parts in by_kind.values() if parts]


def column_list(spark: SparkSession, frames: dict[str, DataFrame], database: str) -> DataFrame:
    rows = [
        (database, name, f.name, i, logical_type(f.dataType))
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return literal_rows(
        spark,
        "id int, database string, dataset string, column string, ordinal int, detected_type string",
        [(i, *row) for i, row in enumerate(rows)],
    )


def profile_columns(
    frames: dict[str, DataFrame], database: str = "source", exact: bool = True
) -> DataFrame:
    """Row, null, non-null and distinct counts of every column of every table.

    Exact form: one shuffle of distinct (column, value) pairs per kind of
    value, for all tables together. Each task first folds repeated values to
    one row with a count, so a value held by a third of the rows costs one row
    per task, and nulls and totals fall out of the same counts.

    `exact=False` takes sketches of all columns in one pass instead, and
    shuffles one row per task.
    """
    spark = next(iter(frames.values())).sparkSession
    if exact:
        counts = union_all(
            cells.groupBy("id", "value").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("id").agg(
                F.sum("copies").alias("total_rows"),
                F.sum(F.when(F.col("value").isNull(), F.col("copies")).otherwise(0))
                .alias("null_count"),
                F.count("value").alias("unique_value_count"),
            )
            for cells in _cells(frames)
        )
    else:
        starts = [0]
        for df in frames.values():
            starts.append(starts[-1] + len(df.columns))
        counts = union_all(_sketched(df, first) for df, first in zip(frames.values(), starts))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    full = column_list(spark, frames, database).join(counts, "id", "left").select(
        "database", "dataset", "column", "ordinal", "detected_type",
        *[zero(c).alias(c) for c in ("total_rows", "null_count", "unique_value_count")],
    )
    filled = F.col("total_rows") - F.col("null_count")
    return full.select(
        "database", "dataset", "column", "ordinal", "detected_type", "total_rows", "null_count",
        share(F.col("null_count"), F.col("total_rows")).alias("null_percentage"),
        filled.alias("non_null_count"),
        "unique_value_count",
        share(F.col("unique_value_count"), filled).alias("uniqueness_percentage"),
    )


def _sketched(df: DataFrame, first: int) -> DataFrame:
    values = [hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(v).alias(f"c{i}") for i, v in enumerate(values)],
        *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(values)],
    )
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(first + i).alias("id"), F.col("n").alias("total_rows"),
            (F.col("n") - F.col(f"c{i}")).alias("null_count"),
            F.col(f"d{i}").alias("unique_value_count"),
        )
        for i in range(len(values))
    ])))


def _row_copies(df: DataFrame, leave: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows with their number of copies; grouping, unlike a window, folds hot rows early.

    Columns to `leave` keep name and value.
    """
    cols = [
        comparable(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}")
        for i, f in enumerate(df.schema.fields) if f.name not in leave
    ]
    keys = [*leave, *[f"c{i}" for i in range(len(cols))]]
    return df.select(*leave, *cols).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_rows(frames: dict[str, DataFrame], database: str = "source") -> DataFrame:
    """Rows beyond the first of each identical row, per table."""
    parts = union_all(
        _row_copies(df).agg(
            F.lit(name).alias("dataset"), F.lit(len(df.columns)).alias("total_columns"),
            F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        for name, df in frames.items()
    )
    return parts.select(
        F.lit(database).alias("database"), "dataset", "total_rows", "total_columns",
        "duplicate_rows",
        share(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_percentage"),
    )


def _fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row; equal rows in the sense of `comparable` have equal ones, long texts are hashed as they are."""
    args = []
    for f in df.schema.fields:
        value = hashable(F.col(f"`{f.name}`"), f.dataType)
        args += [value, value.isNull()]
    return F.xxhash64(F.lit(1), *args), F.xxhash64(F.lit(2), *args)


#: Largest bitmap of a table's repeated fingerprints (64 MB); 16 bits for each, up to 2^25 of them.
MOST_BITS = 1 << 29


def _marked(df: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
    """The rows whose `_h1` has its bit set by some `h1` of `prints`; the bitmap of `bits` bits is broadcast."""
    def place(h):
        slot = h.bitwiseAND(F.lit(bits - 1).cast("long"))
        return F.shiftright(slot, 15).cast("int"), slot.bitwiseAND(F.lit(32767).cast("long"))

    block, at = place(F.col("h1"))
    bitmap = prints.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    block, at = place(F.col("_h1"))
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = F.expr("shiftright(CAST(_octet AS INT), CAST(_at & 7 AS INT)) & 1")
    return df.withColumn("_block", block).join(F.broadcast(bitmap), "_block").withColumns(
        {"_octet": octet, "_at": at}).filter(bit == 1).drop("_block", "_bits", "_octet", "_at")


def duplicate_rows_by_fingerprint(frames: dict[str, DataFrame], database: str = "source") -> DataFrame:
    """The same counts as `duplicate_rows`, for wide rows.

    First only fingerprints of 16 octets are shuffled, folded in each task. Those
    that repeat are stored and marked in a bitmap per table, by which each task picks
    the rows that are compared as a whole; a table without repeated fingerprints is done.
    Rows of equal fingerprint but other content count as distinct. A row that the bitmap lets
    pass without a repeat is alone with its fingerprint and falls out again. No row
    is joined with fingerprints, so long texts are never shuffled, nor are
    rows that do not repeat, while the bitmap has room (`MOST_BITS`).
    """
    prints = []
    for i, df in enumerate(frames.values()):
        first, second = _fingerprint(df)
        prints.append(df.select(F.lit(i).alias("id"), first.alias("h1"), second.alias("h2")))
    counted = stored(union_all(prints).groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
                     .groupBy("id", F.when(F.col("n") > 1, F.col("h1")).alias("h1"),
                              F.when(F.col("n") > 1, F.col("h2")).alias("h2"))
                     .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_prints")), "row-prints")
    parts = [counted.select("id", F.col("n").alias("rows"), F.when(F.col("h1").isNull(), F.col("n_prints"))
                            .otherwise(0).alias("distinct_rows"))]
    repeated = counted.filter("h1 IS NOT NULL").select("id", "h1")
    marked = {r["id"]: r["n"] for r in repeated.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, df in enumerate(frames.values()):
        if i not in marked:
            continue
        first, second = _fingerprint(df)
        bits = min(MOST_BITS, 1 << max(15, (16 * marked[i] - 1).bit_length()))
        likely = _marked(df.withColumns({"_h1": first, "_h2": second}), repeated.filter(F.col("id") == i), bits)
        prints_of = _row_copies(likely, ("_h1", "_h2")).groupBy("_h1", "_h2").agg(
            F.sum("copies").alias("n"), F.count(F.lit(1)).alias("distinct_rows")).filter("n > 1")
        parts.append(prints_of.agg(F.coalesce(F.sum("distinct_rows"), F.lit(0)).alias("distinct_rows")).select(
            F.lit(i).alias("id"), F.lit(0).cast("long").alias("rows"), "distinct_rows"))
    names = literal_rows(counted.sparkSession, "id int, dataset string, total_columns int", [
        (i, name, len(df.columns)) for i, (name, df) in enumerate(frames.items())])
    found = names.join(union_all(parts).groupBy("id").agg(
        F.sum("rows").alias("total_rows"), F.sum("distinct_rows").alias("n_distinct")), "id", "left")
    found = found.fillna(0, ["total_rows", "n_distinct"])  # a table without rows has no fingerprints
    repeats = F.col("total_rows") - F.col("n_distinct")
    return found.select(
        F.lit(database).alias("database"), "dataset", "total_rows", "total_columns", repeats.alias("duplicate_rows"),
        share(repeats, F.col("total_rows")).alias("duplicate_percentage"))


def keep_first(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """First row of each identity by `order`, with the number of rows it stands for.

    A group minimum over a struct merges inside every task, so even a group
    holding a third of the table never meets in one place. Long texts are
    grouped by digest and travel once, inside the kept row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [comparable(F.col(f"`{c}`"), types[c]).alias(f"_k{i}") for i, c in enumerate(identity)]
    rest = [c for c in df.columns if c not in order]
    rank = F.struct(*[comparable(F.col(f"`{c}`"), types[c]) if c in rest or isinstance(types[c], T.MapType)
                      else F.col(f"`{c}`") for c in order + rest])  # a map cannot be ordered itself
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), rank).alias("first")
    grouped = df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("copies"))
    return grouped.select(*[F.col("first").getField(c).alias(c) for c in df.columns], "copies")


_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def data_bytes(frames: dict[str, DataFrame]) -> DataFrame:
    """Estimated data bytes per table: octets of text plus fixed widths of filled primitives."""

    def size(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        width = _FIXED_WIDTH.get(type(f.dataType))
        if width:
            return F.when(c.isNotNull(), width).otherwise(0)
        if isinstance(f.dataType, T.ArrayType) and type(f.dataType.elementType) in _FIXED_WIDTH:
            return F.coalesce(F.size(c) * _FIXED_WIDTH[type(f.dataType.elementType)], F.lit(0))
        text = c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(c)
        return F.coalesce(F.octet_length(text), F.lit(0))

    return union_all(
        df.select(
            F.lit(name).alias("dataset"),
            reduce(lambda a, b: a + b, [size(f).cast("long") for f in df.schema.fields]).alias("b"),
        )
        for name, df in frames.items()
    ).groupBy("dataset").agg(
        F.sum("b").alias("data_bytes"), F.count(F.lit(1)).alias("total_rows")
    )


def quality_summary(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Cells, null cells, duplicates and columns with nulls per table."""
    cells = columns.groupBy("database", "dataset").agg(
        F.sum("total_rows").alias("total_cells"),
        F.sum("null_count").alias("total_null_cells"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
    )
    return cells.join(duplicates, ["database", "dataset"]).select(
        "database", "dataset", "total_cells", "total_null_cells",
        share(F.col("total_null_cells"), F.col("total_cells")).alias("overall_null_percentage"),
        "duplicate_rows", "duplicate_percentage", "columns_with_nulls",
    )


def profiling_issues(
    columns: DataFrame,
    duplicates: DataFrame,
    semantics: DataFrame | None = None,
    key_issues: DataFrame | None = None,
) -> DataFrame:
    """Findings of the profile: empty, duplicated, incomplete and constant data.

    `semantics` is (dataset, column, semantic); columns without an entry raise
    no null finding. An empty table raises EMPTY_DATASET and nothing else.
    """
    def issue(when, kind, severity, affected, share_, message):
        return F.when(when, F.struct(
            kind.alias("issue_type"), severity.alias("severity"),
            affected.cast("long").alias("affected_records"),
            share_.cast("double").alias("affected_percentage"), message.alias("message"),
        ))

    rows, repeats = F.col("total_rows"), F.col("duplicate_rows")
    none = F.lit(None)
    of_tables = duplicates.select(
        "database", "dataset", F.lit("").alias("column"), F.lit(-1).alias("position"),
        F.inline(F.array_compact(F.array(
            issue(rows == 0, F.lit("EMPTY_DATASET"), F.lit(rules.HIGH), rows, none,
                  F.lit("the dataset has no rows")),
            issue(repeats > 0, F.lit("DUPLICATE_ROWS"),
                  grade(F.col("duplicate_percentage"), rules.DUPLICATE_SEVERITY),
                  repeats, F.col("duplicate_percentage"),
                  F.format_string("%d of %d rows repeat an earlier row", repeats, rows)),
        ))),
    )
    if semantics is None:
        ruled = columns.withColumn("semantic", F.lit("unknown"))
    else:
        ruled = columns.join(semantics, ["dataset", "column"], "left")
    nulls, null_share = F.col("null_count"), F.col("null_percentage")
    required = F.coalesce(F.col("semantic").isin(list(rules.REQUIRED_SEMANTICS)), F.lit(False))
    optional = F.coalesce(F.col("semantic") == "optional", F.lit(False)) & (
        null_share < rules.OPTIONAL_SILENT_FROM
    )
    null_message = F.format_string("%d of %d values of %s are null", nulls, rows, F.col("column"))
    of_columns = ruled.select(
        "database", "dataset", "column", F.col("ordinal").alias("position"),
        F.inline(F.array_compact(F.array(
            issue((nulls > 0) & required, F.lit("NULL_VALUES"),
                  grade(null_share, rules.NULL_SEVERITY), nulls, null_share, null_message),
            issue((nulls > 0) & optional, F.lit("NULL_VALUES_OPTIONAL"), F.lit(rules.LOW),
                  nulls, null_share, null_message),
            issue((F.col("non_null_count") > 0) & (F.col("unique_value_count") == 1),
                  F.lit("CONSTANT_COLUMN"), F.lit(rules.LOW), F.col("non_null_count"), none,
                  F.format_string("every filled value of %s is the same", F.col("column"))),
        ))),
    )
    parts = [of_tables, of_columns]
    if key_issues is not None:
        parts.append(key_issues)
    return as_findings(union_all(parts), "PROFILING")


def database_totals(summary: DataFrame, issues: DataFrame, sizes: DataFrame) -> DataFrame:
    """Totals per table and, on rows with a null dataset, per database."""
    per_issue = issues.groupBy("database", "dataset").agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_issues")
          for s in (rules.HIGH, rules.MEDIUM, rules.LOW)],
    )
    joined = (
        summary.join(per_issue, ["database", "dataset"], "left")
        .join(sizes, "dataset", "left")
    )
    measures = {
        "total_rows": "total_rows", "total_columns": "total_columns", "data_bytes": "data_bytes",
        "total_null_cells": "total_null_cells", "duplicate_rows": "duplicate_rows",
        "issues": "issues", "high_issues": "high_issues", "medium_issues": "medium_issues",
        "low_issues": "low_issues",
    }
    return joined.rollup("database", "dataset").agg(
        F.count(F.lit(1)).alias("datasets"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(a) for a, c in measures.items()],
    ).filter(F.col("database").isNotNull())
