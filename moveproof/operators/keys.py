"""Primary keys and foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.functions.rates import cases
from moveproof.functions.text import comparable, is_missing
from moveproof.operators.findings import as_findings
from moveproof.operators.profile import union_all


def key_measures(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, null key cells and rows sharing a key with another row.

    Null key parts are counted cell by cell, and every member of a repeated
    key counts. One group-by on the key gives all three; nulls group together.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [comparable(F.col(f"`{k}`"), types[k]).alias(f"k{i}") for i, k in enumerate(keys)]
    nulls = sum(
        (is_missing(F.col(f"`{k}`"), types[k]).cast("int") for k in keys), F.lit(0)
    ).alias("null_parts")
    grouped = df.select(*parts, nulls).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("null_parts").alias("null_cells")
    )
    zero = F.lit(0).cast("long")
    return grouped.agg(
        F.coalesce(F.sum("n"), zero).alias("total_rows"),
        F.coalesce(F.sum("null_cells"), zero).alias("null_key_cells"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), zero).alias("repeated_key_rows"),
    )


def check_primary_key(
    df: DataFrame, dataset: str, keys: list[str], database: str = "source"
) -> DataFrame:
    """PRIMARY_KEY_MISSING_COLUMNS, PRIMARY_KEY_NULL and PRIMARY_KEY_DUPLICATE findings."""
    label = ", ".join(keys)
    absent = [k for k in keys if k not in df.columns]
    if absent:
        found = df.agg(F.count(F.lit(1)).alias("affected_records")).select(
            "affected_records",
            F.lit("PRIMARY_KEY_MISSING_COLUMNS").alias("issue_type"),
            F.lit(", ".join(absent)).alias("column"),
            F.lit("key columns are absent from the dataset").alias("message"),
        )
    else:
        found = key_measures(df, keys).select(
            F.inline(F.array(
                F.struct(
                    F.lit("PRIMARY_KEY_NULL").alias("issue_type"),
                    F.col("null_key_cells").alias("affected_records"),
                    F.lit("key values are null").alias("message"),
                ),
                F.struct(
                    F.lit("PRIMARY_KEY_DUPLICATE").alias("issue_type"),
                    F.col("repeated_key_rows").alias("affected_records"),
                    F.lit("rows share their key with another row").alias("message"),
                ),
            ))
        ).filter(F.col("affected_records") > 0).withColumn("column", F.lit(label))
    return as_findings(
        found.select(
            "*", F.lit(database).alias("database"), F.lit(dataset).alias("dataset"),
            F.lit(rules.HIGH).alias("severity"), F.lit(-1).alias("position"),
        ),
        "PROFILING",
    )


def fk_orphans(relations: list[dict], null_aware: bool = False) -> DataFrame:
    """Child rows whose non-null key is absent from the parent, one row per relation.

    Each relation is {name, child, child_key, parent, parent_key} with frames
    for child and parent. Child keys are counted before anything is joined, so
    a key holding a third of the child rows travels as one row per task; the
    anti join broadcasts only parents under the session's size threshold.

    `null_aware=True` gives NOT IN semantics: one null parent key hides all
    orphans of that relation.
    """
    parts = []
    for r in relations:
        child = (
            r["child"].select(F.col(r["child_key"]).alias("key"))
            .filter(F.col("key").isNotNull())
            .groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        )
        parent = r["parent"].select(F.col(r["parent_key"]).alias("key"))
        lost = child.join(parent, "key", "left_anti").agg(
            F.lit(r["name"]).alias("relation"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
            F.count(F.lit(1)).alias("orphan_keys"),
            F.lit(0).cast("long").alias("null_parents"),
        )
        parts.append(lost)
        if null_aware:
            parts.append(parent.filter(F.col("key").isNull()).agg(
                F.lit(r["name"]).alias("relation"),
                F.lit(0).cast("long").alias("orphan_rows"),
                F.lit(0).cast("long").alias("orphan_keys"),
                F.count(F.lit(1)).alias("null_parents"),
            ))
    hidden = F.max("null_parents") > 0
    return union_all(parts).groupBy("relation").agg(
        F.when(hidden, 0).otherwise(F.sum("orphan_rows")).cast("long").alias("orphan_rows"),
        F.when(hidden, 0).otherwise(F.sum("orphan_keys")).cast("long").alias("orphan_keys"),
    )


def orphan_findings(orphans: DataFrame, relations: list[dict], database: str = "source"):
    """FOREIGN_KEY_ORPHAN findings for relations with at least one orphan."""
    owner = cases(
        (F.col("relation") == r["name"],
         F.struct(F.lit(r["child_name"]).alias("dataset"), F.lit(r["child_key"]).alias("column")))
        for r in relations
    )
    return as_findings(
        orphans.filter(F.col("orphan_rows") > 0).withColumn("o", owner).select(
            F.lit(database).alias("database"), "o.dataset", "o.column",
            F.lit("FOREIGN_KEY_ORPHAN").alias("issue_type"), F.lit(rules.HIGH).alias("severity"),
            F.col("orphan_rows").alias("affected_records"),
            F.format_string("%s has %d orphan rows", "relation", "orphan_rows").alias("message"),
            F.lit(-1).alias("position"),
        ),
        "FOREIGN_KEY",
    )
