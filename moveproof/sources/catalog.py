"""Inventories of tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.operators.profile import union_all
from moveproof.operators.shape import sample_view
from moveproof.session import literal_rows


def not_system(name: Column) -> Column:
    return ~F.lower(name).isin(list(rules.SYSTEM_TABLES))


def table_inventory(
    frames: dict[str, DataFrame], database: str = "source", dataset_type: str = "TABLE"
) -> DataFrame:
    """Row and column count per table, system tables excluded, counted in one job.

    The scans read no column, and one grouped count serves all tables.
    """
    spark = next(iter(frames.values())).sparkSession
    kept = {n: d for n, d in frames.items() if n.lower() not in rules.SYSTEM_TABLES}
    counts = union_all(
        df.select(F.lit(name).alias("dataset")) for name, df in kept.items()
    ).groupBy("dataset").agg(F.count(F.lit(1)).alias("record_count"))
    widths = literal_rows(
        spark, "database string, dataset string, dataset_type string, column_count int",
        [(database, n, dataset_type, len(d.columns)) for n, d in kept.items()],
    )
    return widths.join(counts, "dataset", "left").select(
        "database", "dataset", "dataset_type",
        F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"), "column_count",
    )


def column_inventory(frames: dict[str, DataFrame], database: str = "source") -> DataFrame:
    """Table, column, position, type and nullability from the schemas alone."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (database, n, i, f.name, f.dataType.simpleString(), f.nullable)
        for n, d in frames.items() if n.lower() not in rules.SYSTEM_TABLES
        for i, f in enumerate(d.schema.fields)
    ]
    return literal_rows(
        spark, "database string, dataset string, ordinal int, column string, data_type string, "
        "nullable boolean", rows,
    )


def catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of a catalog database as frames; the listing is metadata only."""
    return {
        t.name: spark.table(f"`{database}`.`{t.name}`")
        for t in spark.catalog.listTables(database)
    }


def document_width(docs: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distinct top-level keys of JSON documents per group, `_id` excluded."""
    keys = docs.select(*by, F.explode(F.json_object_keys(F.col(column))).alias("key")).filter(
        F.col("key") != "_id"
    )
    # folded to one row per (group, key) inside each task before the count
    return keys.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("field_count"))


def create_count_function(spark: SparkSession, name: str, df: DataFrame) -> str:
    """A session SQL function `fn_<name>_count()` that counts the table's rows."""
    view, function = f"v_{name}_rows", f"fn_{name}_count"
    df.createOrReplaceTempView(view)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {function}() RETURNS BIGINT "
        f"RETURN (SELECT count(*) FROM {view})"
    )
    return function


def create_sample_view(df: DataFrame, name: str, order: list[str]) -> str:
    """The generated view `v_<name>`: all columns, first rows in key order."""
    view = f"v_{name}"
    sample_view(df, order).createOrReplaceTempView(view)
    return view


def tables_without(frames: dict[str, DataFrame], column: str) -> list[str]:
    """Tables a column-based rule, such as stamping, has to skip."""
    return sorted(n for n, df in frames.items() if column not in df.columns)
