"""Schema drift, registries, versions, evolution plans and contracts, all as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.functions.names import strip
from moveproof.functions.text import comparable
from moveproof.functions.types import physical_type, resolved_type
from moveproof.operators.ranking import change_numbered, numbered

#: Registry positions that are numbered together.
CHUNK = 10_000


def _folded(df: DataFrame) -> DataFrame:
    return df.withColumn("folded", F.lower(strip(F.col("column"))))


def schema_drift(registry: DataFrame, current: DataFrame) -> DataFrame:
    """NEW / CHANGED / DELETED / UNCHANGED per current table, ignoring case.

    DELETED means that columns vanished and none were added. Observations are
    first folded to one row per (table, column), which is all that meets per table.
    """
    seen = (
        _folded(registry).select("table", "folded", F.lit(True).alias("old"))
        .unionByName(_folded(current).select("table", "folded", F.lit(False).alias("old")))
        .groupBy("table", "folded")
        .agg(F.bool_or("old").alias("was"), F.bool_or(~F.col("old")).alias("is"))
    )
    added, gone = F.col("is") & ~F.col("was"), F.col("was") & ~F.col("is")

    def listed(cond):
        return F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("folded")))), ",")

    return seen.groupBy("table").agg(
        F.count_if("was").alias("old_columns"), F.count_if("is").alias("current_columns"),
        F.count_if(added).alias("added_count"), F.count_if(gone).alias("deleted_count"),
        listed(added).alias("added_columns"), listed(gone).alias("gone_columns"),
    ).filter(F.col("current_columns") > 0).select(
        "table",
        F.when(F.col("old_columns") == 0, "NEW").when(F.col("added_count") > 0, "CHANGED")
        .when(F.col("deleted_count") > 0, "DELETED").otherwise("UNCHANGED").alias("status"),
        "added_columns",
        F.when(F.col("old_columns") == 0, "").otherwise(F.col("gone_columns"))
        .alias("deleted_columns"),
    )


def column_changes(registry: DataFrame, current: DataFrame) -> DataFrame:
    """(table, column, change): ADDED and REMOVED columns of the current tables, ignoring case, a row each."""
    tables = current.select("table").distinct()
    seen = (
        _folded(registry).join(tables, "table", "left_semi").select("table", "folded", F.lit(True).alias("old"))
        .unionByName(_folded(current).select("table", "folded", F.lit(False).alias("old")))
        .groupBy("table", "folded")
        .agg(F.bool_or("old").alias("was"), F.bool_or(~F.col("old")).alias("is"))
    )
    return seen.filter(F.col("was") != F.col("is")).select(
        "table", F.col("folded").alias("column"), F.when(F.col("is"), "ADDED").otherwise("REMOVED").alias("change"))


def with_renames(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """`column_changes` in which a pair of REMOVED and ADDED that `renames` (table, old, new) names is one RENAMED row.

    (table, column, change, renamed_to); `renamed_to` is null but for RENAMED.
    """
    pairs = renames.select("table", F.lower(strip(F.col("old"))).alias("old"), F.lower(strip(F.col("new"))).alias("new"))
    old = pairs.select("table", F.col("old").alias("column"), F.lit("REMOVED").alias("change"), F.col("new").alias("renamed_to"))
    new = pairs.select("table", F.col("new").alias("column"), F.lit("ADDED").alias("change"))
    kept = changes.join(new, ["table", "column", "change"], "left_anti").join(old, ["table", "column", "change"], "left")
    renamed = F.col("renamed_to").isNotNull()
    return kept.withColumn("change", F.when(renamed, "RENAMED").otherwise(F.col("change"))).select(
        "table", "column", "change", "renamed_to")


def schema_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New, removed and existing columns per table, case-sensitive, in registry order.

    Inputs are registries (table, ordinal, column).
    """
    def listed(df, name):
        first = df.groupBy("table", "column").agg(F.min("ordinal").alias("ordinal"))
        return first.groupBy("table").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]
            ).alias(name)
        )

    empty = F.array().cast("array<string>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    return listed(current, "new").join(listed(previous, "old"), "table", "left").select(
        "table",
        F.array_join(F.array_except(new, old), ",").alias("new_columns"),
        F.array_join(F.array_except(old, new), ",").alias("removed_columns"),
        F.array_join(F.array_intersect(new, old), ",").alias("existing_columns"),
    )


def registry_merge(registry: DataFrame, current: DataFrame) -> DataFrame:
    """Additive union (table, ordinal, column): known columns first, spelled as first seen."""
    def tagged(df, source):
        return _folded(df).select(
            "table", "folded",
            F.struct(F.lit(source).alias("source"), "ordinal", F.col("column")).alias("seen"),
        )

    first = (
        tagged(registry, 0).unionByName(tagged(current, 1))
        .groupBy("table", "folded").agg(F.min("seen").alias("seen"))
    )
    placed = first.select("table", "seen.*").withColumn("chunk", F.floor(F.col("ordinal") / CHUNK))
    ranked = numbered(placed, ["table"], ["source", "chunk"], ["ordinal", "column"])
    return ranked.select("table", (F.col("rank") - 1).cast("int").alias("ordinal"), "column")


def schema_versions(log: DataFrame, chunk: str, order: list[str]) -> DataFrame:
    """Version of each observation (table, columns text): it rises when the list differs from the last."""
    return change_numbered(log, "table", chunk, order, "columns", "version")


def evolution_plan(registry: DataFrame, covered: DataFrame, target: str) -> DataFrame:
    """Registered columns the target does not have, with the action and physical type each needs.

    Inputs: registry (database, table, column, selected_type, detected_type) and
    covered (database, table, column).
    """
    known_tables = covered.select("database", "table").distinct().withColumn("known", F.lit(True))
    missing = registry.join(
        covered.select("database", "table", "column"), ["database", "table", "column"], "left_anti"
    )
    logical = resolved_type(F.col("selected_type"), F.col("detected_type"))
    return missing.join(known_tables, ["database", "table"], "left").select(
        "database", "table", "column",
        F.when(F.col("known"), "ADD_COLUMN").otherwise("CREATE_TABLE").alias("action"),
        logical.alias("logical_type"),
        physical_type(logical, target).alias("physical_type"),
    )


def changed_databases(plan: DataFrame, databases: DataFrame) -> DataFrame:
    """Whether the schema of each database must change before a load."""
    changes = plan.groupBy("database").agg(F.count(F.lit(1)).alias("planned_changes"))
    n = F.coalesce("planned_changes", F.lit(0)).cast("long")
    return databases.join(changes, "database", "left").select(
        "database", n.alias("planned_changes"), (n > 0).alias("schema_changed")
    )


def contract_breaches(required: DataFrame, present: DataFrame, counts: DataFrame) -> DataFrame:
    """Tables that arrived without rows, and required columns that others lack, ignoring case.

    Inputs: required and present (table, column), counts (table, record_count).
    """
    filled = counts.filter(F.col("record_count") > 0).select("table")
    wanted = required.select("table", "column")
    empty = wanted.select("table").distinct().join(filled, "table", "left_anti").select(
        "table", F.lit(None).cast("string").alias("column"), F.lit("EMPTY_FILE").alias("problem")
    )
    lost = (
        _folded(wanted)
        .join(_folded(present).select("table", "folded"), ["table", "folded"], "left_anti")
        .join(filled, "table", "left_semi")
    )
    return empty.unionByName(
        lost.select("table", "column", F.lit("MISSING_COLUMN").alias("problem"))
    )


def schema_audit(registry: DataFrame, current: DataFrame, run_ts: str) -> DataFrame:
    """ADD_TABLE and ADD_COLUMN rows for everything the registry does not hold yet.

    Registered columns start as the default text type; names are case-sensitive.
    """
    new_columns = current.select("table", "column").distinct().join(
        registry.select("table", "column"), ["table", "column"], "left_anti"
    )
    new_tables = current.select("table").distinct().join(
        registry.select("table"), "table", "left_anti"
    )
    rows = new_tables.select(
        "table", F.lit(None).cast("string").alias("column"), F.lit("ADD_TABLE").alias("action"),
        F.lit(None).cast("string").alias("storage_type"),
    ).unionByName(new_columns.select(
        "table", "column", F.lit("ADD_COLUMN").alias("action"),
        F.lit(rules.NAME_HINT_DEFAULT).alias("storage_type"),
    ))
    return rows.withColumn("audit_ts", F.lit(run_ts))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by `order`: a group maximum, so it merges inside every task."""
    rest = [c for c in df.columns if c not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    rank = F.struct(*[F.col(c) for c in order], *[
        comparable(F.col(f"`{c}`"), types[c]) for c in rest if c not in order])
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col("last").getField(c).alias(c) for c in rest])
