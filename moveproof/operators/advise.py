"""Findings and assessments to recommendations, actions and a governance decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.operators.profile import union_all
from moveproof.operators.ranking import numbered
from moveproof.session import literal_rows

_ISSUE_ORDER = (
    "EMPTY_DATASET", "DUPLICATE_ROWS", "PRIMARY_KEY_MISSING_COLUMNS", "PRIMARY_KEY_NULL",
    "PRIMARY_KEY_DUPLICATE", "NULL_VALUES", "NULL_VALUES_OPTIONAL", "CONSTANT_COLUMN",
    "MISSING_TARGET_DATASET", "ROW_COUNT_MISMATCH", "COLUMN_COUNT_MISMATCH",
    "COLUMN_COUNT_MISMATCH_MINOR", "EXTRA_TARGET_DATASET", "FOREIGN_KEY_ORPHAN",
)
_COLUMNS = (
    "run_id", "database", "recommendation_id", "category", "priority", "title", "finding",
    "source", "dataset", "column",
)


def issue_order(issue_type: str) -> int:
    return _ISSUE_ORDER.index(issue_type)


def priority_rank(priority: Column) -> Column:
    order = F.create_map(*[F.lit(x) for kv in rules.PRIORITY_ORDER.items() for x in kv])
    return F.coalesce(F.try_element_at(order, priority), F.lit(99))


def rule_table(spark: SparkSession, extended: bool = False) -> DataFrame:
    chosen = rules.RECOMMENDATION_RULES + (rules.EXTENDED_RECOMMENDATION_RULES if extended else [])
    return literal_rows(
        spark,
        "source string, issue_type string, prefix string, category string, title string, "
        "issue_order int",
        [(*r, issue_order(r[1])) for r in chosen],
    )


def _advised(findings: DataFrame, extended: bool) -> DataFrame:
    return findings.join(
        rule_table(findings.sparkSession, extended), ["source", "issue_type"]
    ).fillna({"run_id": "", "dataset": "", "position": 0})


def unordered(findings: DataFrame, assessed: DataFrame, extended: bool = False) -> DataFrame:
    """All recommendations without ids and order, for counting."""
    parts = [
        _advised(findings, extended).withColumnRenamed("severity", "priority"),
        strategic(assessed),
    ]
    return union_all([x.select("run_id", "database", "category", "priority") for x in parts])


def from_findings(findings: DataFrame, extended: bool = False) -> DataFrame:
    """Recommendations for findings that have a rule, numbered per run, database and source.

    Numbers run over datasets by name, then by kind of issue and column position.
    """
    advised = _advised(findings, extended)
    ranked = numbered(
        advised, ["run_id", "database", "prefix"], ["dataset"],
        ["issue_order", "position", "column"], "n",
    )
    return ranked.select(
        "run_id", "database",
        F.format_string("%s-%03d", "prefix", "n").alias("recommendation_id"),
        "category", F.col("severity").alias("priority"), "title",
        F.col("message").alias("finding"), "source", "dataset", "column",
        F.when(F.col("prefix") == "PROF", 1).otherwise(2).alias("block"), F.col("n").alias("seq"),
    )


def strategic(assessed: DataFrame) -> DataFrame:
    """Up to three recommendations per assessment row, from its levels."""
    parts = []
    for i, (column, levels, rec_id, category, priority, title) in enumerate(rules.STRATEGIC_RULES):
        parts.append(F.when(F.col(column).isin(list(levels)), F.struct(
            F.lit(rec_id).alias("recommendation_id"), F.lit(category).alias("category"),
            (F.col(column) if priority is None else F.lit(priority)).alias("priority"),
            F.lit(title).alias("title"),
            F.concat(F.lit(column.replace("_", " ") + " is "), F.col(column)).alias("finding"),
            F.lit(i).cast("long").alias("seq"),
        )))
    return assessed.select(
        F.coalesce("run_id", F.lit("")).alias("run_id"), "database",
        F.inline(F.array_compact(F.array(*parts))),
    ).select(
        "*", F.lit("ASSESSMENT").alias("source"), F.lit("").alias("dataset"),
        F.lit(None).cast("string").alias("column"), F.lit(3).alias("block"),
    )


def recommendations(findings: DataFrame, assessed: DataFrame, extended: bool = False) -> DataFrame:
    """All recommendations with their position in priority order."""
    merged = union_all([from_findings(findings, extended), strategic(assessed)])
    ordered = numbered(
        merged.withColumn("rank", priority_rank(F.col("priority"))),
        ["run_id", "database"], ["rank", "block", "dataset"], ["seq"], "order_no",
    )
    return ordered.select(*_COLUMNS, "order_no")


def action_plan(recommended: DataFrame) -> DataFrame:
    """One open action per recommendation: owner, whether it blocks approval, what it requires."""
    owners = F.create_map(*[F.lit(x) for kv in rules.OWNERS.items() for x in kv])
    blocking = F.col("priority").isin(rules.CRITICAL, rules.HIGH) | F.col("category").isin(
        list(rules.BLOCKING_CATEGORIES)
    )
    return recommended.select(
        "run_id", "database",
        F.format_string("ACT-%03d", "order_no").alias("action_id"),
        "recommendation_id", "title", "category", "priority",
        F.coalesce(F.try_element_at(owners, F.col("category")), F.lit(rules.DEFAULT_OWNER))
        .alias("suggested_owner"),
        blocking.alias("approval_blocking"),
        F.when(blocking, "MUST_RESOLVE_BEFORE_APPROVAL").otherwise("REVIEW_AND_TRACK")
        .alias("resolution_requirement"),
        F.lit("OPEN").alias("action_status"),
        "dataset", "column", "finding", "source",
    )


def governance(actions: DataFrame) -> DataFrame:
    blocking = F.count_if("approval_blocking")
    still_open = F.count_if(F.col("action_status") == "OPEN")
    return actions.groupBy("run_id", "database").agg(
        F.when(blocking > 0, "APPROVAL_BLOCKED").when(still_open > 0, "APPROVAL_WITH_ACTIONS")
        .otherwise("APPROVAL_READY").alias("governance_decision"),
        F.count(F.lit(1)).alias("total_actions"),
        still_open.alias("open_actions"),
        blocking.alias("blocking_actions"),
        *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_actions")
          for p in rules.PRIORITY_ORDER],
    )


def recommendation_counts(recommended: DataFrame) -> DataFrame:
    return recommended.groupBy("run_id", "database").agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        F.count_if(F.col("priority") == rules.CRITICAL).alias("critical_recommendations"),
        F.count_if(F.col("priority") == rules.HIGH).alias("high_recommendations"),
    )
