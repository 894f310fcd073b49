"""Source against target: presence, row counts, column counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.functions.rates import grade, match_share
from moveproof.operators.findings import as_findings
from moveproof.operators.profile import union_all


def reconcile(expected: DataFrame, actual: DataFrame, database: str = "source") -> DataFrame:
    """Expected and actual inventories (dataset, record_count, column_count) side by side."""
    left = expected.select(
        F.lower("dataset").alias("key"), F.col("dataset").alias("expected_name"),
        F.col("record_count").alias("expected_rows"),
        F.col("column_count").alias("expected_columns"),
    )
    right = actual.select(
        F.lower("dataset").alias("key"), F.col("dataset").alias("target_name"),
        F.col("record_count").alias("actual_rows"), F.col("column_count").alias("actual_columns"),
    )
    missing = F.col("target_name").isNull()
    extra = F.col("expected_name").isNull()
    same = (F.col("expected_rows") == F.col("actual_rows")) & (
        F.col("expected_columns") == F.col("actual_columns")
    )
    row_gap = F.col("actual_rows") - F.col("expected_rows")
    column_gap = F.col("actual_columns") - F.col("expected_columns")
    return left.join(right, "key", "full_outer").select(
        F.lit(database).alias("database"),
        F.coalesce("expected_name", "target_name").alias("dataset"),
        "expected_rows", "actual_rows",
        row_gap.alias("row_difference"),
        F.abs(row_gap).alias("absolute_row_difference"),
        F.when(~missing & ~extra, match_share(F.col("expected_rows"), F.col("actual_rows")))
        .alias("match_percentage"),
        "expected_columns", "actual_columns",
        column_gap.alias("column_difference"),
        F.when(missing, "MISSING_TARGET_DATASET").when(extra, "EXTRA_TARGET_DATASET")
        .when(same, "RECONCILED").otherwise("NOT_RECONCILED").alias("status"),
    )


def reconciliation_issues(reconciled: DataFrame) -> DataFrame:
    """Findings of a reconciliation; a dataset may raise a row and a column finding."""
    status = F.col("status")
    both = status.isin("RECONCILED", "NOT_RECONCILED")
    dataset = F.col("dataset")

    def issue(when, kind, severity, expected, actual, message, position):
        return F.when(when, F.struct(
            F.lit(kind).alias("issue_type") if isinstance(kind, str) else kind.alias("issue_type"),
            severity.alias("severity"),
            expected.cast("double").alias("expected"), actual.cast("double").alias("actual"),
            message.alias("message"), F.lit(position).alias("position"),
        ))

    none = F.lit(None)
    minor = F.abs("column_difference") <= rules.MINOR_COLUMN_DIFFERENCE
    found = F.array_compact(F.array(
        issue(status == "MISSING_TARGET_DATASET", "MISSING_TARGET_DATASET", F.lit(rules.HIGH),
              F.col("expected_rows"), none,
              F.concat(dataset, F.lit(" is not in the target")), 0),
        issue(status == "EXTRA_TARGET_DATASET", "EXTRA_TARGET_DATASET", F.lit(rules.MEDIUM),
              none, F.col("actual_rows"),
              F.concat(dataset, F.lit(" has no source dataset")), 0),
        issue(both & (F.col("row_difference") != 0), "ROW_COUNT_MISMATCH",
              grade(F.col("match_percentage"), rules.ROW_MATCH_SEVERITY),
              F.col("expected_rows"), F.col("actual_rows"),
              F.format_string("%s: %d rows expected, %d found", dataset,
                              F.col("expected_rows"), F.col("actual_rows")), 0),
        issue(both & (F.col("column_difference") != 0),
              F.when(minor, "COLUMN_COUNT_MISMATCH_MINOR").otherwise("COLUMN_COUNT_MISMATCH"),
              F.when(minor, rules.MEDIUM).otherwise(rules.HIGH),
              F.col("expected_columns"), F.col("actual_columns"),
              F.format_string("%s: %d columns expected, %d found", dataset,
                              F.col("expected_columns"), F.col("actual_columns")), 1),
    ))
    return as_findings(
        reconciled.select("database", "dataset", F.inline(found)), "RECONCILIATION"
    )


def reconciliation_summary(reconciled: DataFrame, issues: DataFrame, executed: bool = True):
    """One row per database: how many datasets agree, and findings by severity.

    `executed=False` records that the target could not be reached: every count
    but the number of expected datasets is zero.
    """
    status = F.col("status")
    missing = status == "MISSING_TARGET_DATASET"
    extra = status == "EXTRA_TARGET_DATASET"
    run = F.lit(executed)

    def count(cond):
        return F.when(run, F.count_if(cond)).otherwise(0).cast("long")

    sides = {
        "expected_datasets": F.count_if(~extra),
        "target_datasets": count(~missing),
        "reconciled_datasets": count(status == "RECONCILED"),
        "not_reconciled_datasets": count(missing | (status == "NOT_RECONCILED")),
        "missing_target_datasets": count(missing),
        "extra_target_datasets": count(extra),
    }
    severities = {"total_issues": count(F.lit(True))} | {
        f"{s.lower()}_severity_issues": count(F.col("severity") == s)
        for s in (rules.HIGH, rules.MEDIUM, rules.LOW)
    }
    measured = union_all([
        reconciled.groupBy("database").agg(*[c.alias(n) for n, c in sides.items()]),
        issues.groupBy("database").agg(*[c.alias(n) for n, c in severities.items()]),
    ])
    return measured.groupBy("database").agg(*[
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in [*sides, *severities]
    ]).withColumn(
        "reconciliation_status", F.lit("EXECUTED" if executed else rules.NOT_EXECUTED)
    )


def presence(registered: DataFrame, inventory: DataFrame) -> DataFrame:
    """Registered tables against the target: PRESENT with their row count, or MISSING."""
    have = inventory.select(F.lower("dataset").alias("folded"), "record_count")
    found = registered.withColumn("folded", F.lower("table")).join(have, "folded", "left")
    return found.select(
        "table",
        F.when(F.col("record_count").isNull(), "MISSING").otherwise("PRESENT").alias("status"),
        F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"),
    )
