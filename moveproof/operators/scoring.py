"""Risk, complexity and readiness of a fleet: one row per (run, database), scored by expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.functions.rates import cases, grade
from moveproof.operators.findings import as_findings

KEYS = ["run_id", "database"]

# measures a fleet row carries
FLEET_COLUMNS = {
    "profiling_high": "long", "profiling_medium": "long", "profiling_low": "long",
    "reconciliation_high": "long", "reconciliation_medium": "long", "reconciliation_low": "long",
    "reconciliation_status": "string", "missing_target_datasets": "long",
    "extra_target_datasets": "long", "not_reconciled_datasets": "long",
    "growth_status": "string", "overall_growth_rate_percent": "double",
    "retention_days": "int", "archive_required": "boolean",
    "max_duration_minutes": "int", "max_downtime_minutes": "int",
    "total_rows": "long", "total_datasets": "long", "total_columns": "long",
}


def _issue_score(prefix: str) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.col(f"{prefix}_{k}") * w for k, w in rules.ISSUE_WEIGHTS.items()],
    )


def _growth_risk() -> tuple[Column, Column]:
    rate = F.col("overall_growth_rate_percent")
    known = (F.col("growth_status") != "BASELINE_CREATED") & rate.isNotNull()
    score, severity = F.when(~known, 0), F.when(~known, rules.LOW)
    for bound, points, label in rules.GROWTH_RISK:
        score, severity = score.when(rate >= bound, points), severity.when(rate >= bound, label)
    return score.otherwise(0), severity.otherwise(rules.LOW)


def _retention_risk() -> tuple[Column, Column]:
    days, archive = F.col("retention_days"), F.col("archive_required")
    long_term = (days >= rules.LONG_RETENTION_DAYS) & archive
    planned = (days >= rules.MID_RETENTION_DAYS) | archive
    return (
        F.when(long_term, 10).when(planned, 5).otherwise(0),
        F.when(long_term, rules.HIGH).when(planned, rules.MEDIUM).otherwise(rules.LOW),
    )


def _step(value: Column, strict: int, controlled: int, high: int, mid: int) -> Column:
    """Points of one service-level limit; a limit of zero is not set."""
    return F.when(value <= 0, 0).when(value <= strict, high).when(value <= controlled, mid) \
        .otherwise(0)


def _sla_points(high: int, mid: int) -> tuple[Column, Column]:
    return (
        _step(F.col("max_duration_minutes"), rules.STRICT_DURATION_MIN,
              rules.CONTROLLED_DURATION_MIN, high, mid),
        _step(F.col("max_downtime_minutes"), rules.STRICT_DOWNTIME_MIN,
              rules.CONTROLLED_DOWNTIME_MIN, high, mid),
    )


def _has_sla() -> Column:
    return (F.col("max_duration_minutes") > 0) | (F.col("max_downtime_minutes") > 0)


def risk(fleet: DataFrame) -> DataFrame:
    """Risk scores and level. The profiling score is reported but not part of the total.

    The downtime limit sets the severity of the service-level risk whenever it
    scores, even if the duration limit scored higher.
    """
    growth, growth_severity = _growth_risk()
    retention, retention_severity = _retention_risk()
    duration, downtime = _sla_points(10, 5)
    severity_of = lambda p: F.when(p == 10, rules.HIGH).when(p == 5, rules.MEDIUM)
    scored = fleet.select(
        "*",
        _issue_score("profiling").alias("profiling_risk_score"),
        _issue_score("reconciliation").alias("reconciliation_risk_score"),
        growth.alias("growth_risk_score"), growth_severity.alias("growth_severity"),
        retention.alias("retention_risk_score"), retention_severity.alias("retention_severity"),
        F.greatest(duration, downtime).alias("sla_risk_score"),
        F.coalesce(severity_of(downtime), severity_of(duration), F.lit(rules.LOW))
        .alias("sla_severity"),
        F.when(_has_sla(), "CONFIGURED").otherwise("NOT_APPLICABLE").alias("sla_status"),
    ).withColumn(
        "discovery_risk_score",
        F.col("growth_risk_score") + F.col("retention_risk_score") + F.col("sla_risk_score"),
    ).withColumn(
        "risk_score", F.col("reconciliation_risk_score") + F.col("discovery_risk_score")
    )
    raised = lambda level: reduce(lambda a, b: a + b, [
        F.when((F.col(f"{s}_severity") == level) & (F.col(f"{s}_risk_score") > 0), 1).otherwise(0)
        for s in ("growth", "retention", "sla")
    ])
    return scored.withColumns({
        "risk_level": grade(F.col("risk_score"), rules.RISK_LEVEL),
        "risk_high_issues": F.col("profiling_high") + F.col("reconciliation_high")
        + raised(rules.HIGH),
        "risk_medium_issues": F.col("profiling_medium") + F.col("reconciliation_medium")
        + raised(rules.MEDIUM),
        "risk_low_issues": F.col("profiling_low") + F.col("reconciliation_low"),
    })


def risk_factors(scored: DataFrame) -> DataFrame:
    """One row per source that contributes to the risk of a database."""
    def factor(source, severity, count, when):
        return F.when(when, F.struct(
            F.lit(source).alias("source"), severity.alias("severity"),
            count.cast("long").alias("issue_count"),
        ))

    parts = [
        factor(source.upper(), F.lit(level), F.col(f"{source}_{level.lower()}"),
               F.col(f"{source}_{level.lower()}") > 0)
        for source in ("profiling", "reconciliation") for level in (rules.HIGH, rules.MEDIUM)
    ] + [
        factor(f"DISCOVERY_{s.upper()}", F.col(f"{s}_severity"), F.lit(1),
               F.col(f"{s}_risk_score") > 0)
        for s in ("growth", "retention", "sla")
    ]
    return scored.select(*KEYS, F.inline(F.array_compact(F.array(*parts))))


def complexity(fleet: DataFrame) -> DataFrame:
    growth = F.when(
        (F.col("growth_status") == "ANALYZED") & F.col("overall_growth_rate_percent").isNotNull(),
        grade(F.col("overall_growth_rate_percent"), rules.GROWTH_SCORE),
    ).otherwise(0)
    gaps = (
        F.least(F.col("missing_target_datasets") * 5, F.lit(15))
        + F.least(F.col("extra_target_datasets") * 2, F.lit(10))
        + F.least(F.col("not_reconciled_datasets") * 3, F.lit(15))
    )
    parts = {
        "volume_score": grade(F.col("total_rows"), rules.VOLUME_SCORE),
        "dataset_score": grade(F.col("total_datasets"), rules.DATASET_SCORE),
        "width_score": grade(F.col("total_columns"), rules.WIDTH_SCORE),
        "reconciliation_score": gaps.cast("int"),
        "growth_score": growth,
    }
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return fleet.withColumns(parts).withColumn("complexity_score", total).withColumn(
        "complexity_level", grade(F.col("complexity_score"), rules.COMPLEXITY_LEVEL)
    )


def _by_level(col: Column, points: dict[str, int]) -> Column:
    return cases((col == level, p) for level, p in points.items()).otherwise(0)


def readiness(assessed: DataFrame) -> DataFrame:
    """Readiness from 100 down by capped penalties; needs risk_level and complexity_level.

    Without any service-level limit the retention penalty is dropped as well.
    """
    weights = lambda *terms: reduce(
        lambda a, b: a + b, [F.col(c) * w for c, w in terms]
    )
    profiling = F.least(
        weights(("profiling_high", 8), ("profiling_medium", 4), ("profiling_low", 1)), F.lit(35)
    )
    reconciliation = F.when(F.col("reconciliation_status") == rules.NOT_EXECUTED, 0).otherwise(
        F.least(weights(
            ("reconciliation_high", 10), ("reconciliation_medium", 5), ("reconciliation_low", 2),
            ("missing_target_datasets", 5), ("not_reconciled_datasets", 3),
        ), F.lit(45))
    )
    retention = (
        F.when(F.col("retention_days") >= rules.LONG_RETENTION_DAYS, 5)
        .when(F.col("retention_days") >= rules.MID_RETENTION_DAYS, 3).otherwise(0)
        + F.when(F.col("archive_required"), 2).otherwise(0)
    )
    duration, downtime = _sla_points(5, 3)
    parts = {
        "profiling_penalty": profiling.cast("int"),
        "reconciliation_penalty": reconciliation.cast("int"),
        "risk_penalty": _by_level(F.col("risk_level"), rules.RISK_PENALTY),
        "complexity_penalty": _by_level(F.col("complexity_level"), rules.COMPLEXITY_PENALTY),
        "retention_penalty": F.when(_has_sla(), retention).otherwise(0),
        "sla_penalty": duration + downtime,
    }
    total = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return assessed.withColumns(parts).withColumn("total_penalty", total).withColumn(
        "readiness_score", F.greatest(F.lit(0), F.lit(100) - F.col("total_penalty"))
    ).withColumn("readiness_level", grade(F.col("readiness_score"), rules.READINESS_LEVEL))


def assessment_status(risk_level: Column, readiness_level: Column) -> Column:
    return (
        F.when((risk_level == rules.CRITICAL) | (readiness_level == "NOT_READY"), "ACTION_REQUIRED")
        .when(readiness_level == "NEEDS_REMEDIATION", "REMEDIATION_REQUIRED")
        .when(readiness_level == "READY_WITH_CONDITIONS", "CONDITIONAL_APPROVAL")
        .otherwise("READY_FOR_NEXT_STAGE")
    )


def assess(fleet: DataFrame) -> DataFrame:
    """Every score, level and status of each fleet row, without any shuffle."""
    return readiness(complexity(risk(fleet))).withColumn(
        "assessment_status", assessment_status(F.col("risk_level"), F.col("readiness_level"))
    )


def complexity_factors(scored: DataFrame) -> DataFrame:
    """One row per factor of the complexity score; gaps and growth only when they score."""
    def factor(name, score, observed, when=None):
        row = F.struct(
            F.lit(name).alias("factor"), F.col(score).cast("int").alias("score"),
            observed.cast("double").alias("observed_value"),
        )
        return row if when is None else F.when(when, row)

    gaps = (
        F.col("missing_target_datasets") + F.col("extra_target_datasets")
        + F.col("not_reconciled_datasets")
    )
    parts = [
        factor("DATA_VOLUME", "volume_score", F.col("total_rows")),
        factor("DATASET_COUNT", "dataset_score", F.col("total_datasets")),
        factor("SCHEMA_WIDTH", "width_score", F.col("total_columns")),
        factor("RECONCILIATION_FINDINGS", "reconciliation_score", gaps,
               F.col("reconciliation_score") > 0),
        factor("DATABASE_GROWTH", "growth_score", F.col("overall_growth_rate_percent"),
               F.col("growth_score") > 0),
    ]
    return scored.select(*KEYS, F.inline(F.array_compact(F.array(*parts))))


# --- fixed values: penalty column -> factor name ---
READINESS_FACTORS = {
    "profiling_penalty": "DATA_QUALITY", "reconciliation_penalty": "RECONCILIATION",
    "risk_penalty": "MIGRATION_RISK", "complexity_penalty": "MIGRATION_COMPLEXITY",
    "retention_penalty": "RETENTION_REQUIREMENTS", "sla_penalty": "SLA_REQUIREMENTS",
}


def readiness_factors(scored: DataFrame) -> DataFrame:
    """One row per penalty above zero; a reconciliation that did not run is listed with zero."""
    parts = []
    for column, name in READINESS_FACTORS.items():
        listed = F.col(column) > 0
        if name == "RECONCILIATION":
            listed = listed | (F.col("reconciliation_status") == rules.NOT_EXECUTED)
        parts.append(F.when(listed, F.struct(
            F.lit(name).alias("factor"), F.col(column).cast("int").alias("penalty")
        )))
    return scored.select(*KEYS, F.inline(F.array_compact(F.array(*parts))))


def parsed_requirements(requirements: DataFrame) -> DataFrame:
    """Requirement rows (database, four text fields) as numbers and a flag; what breaks a rule is null."""
    number = lambda c: F.col(c).try_cast("int")
    least = {"retention_days": 0, "max_duration_minutes": 1, "max_downtime_minutes": 0}
    return requirements.select(
        "database", *[F.when(number(c) >= n, number(c)).alias(c) for c, n in least.items()],
        F.col("archive_required").try_cast("boolean").alias("archive_required"))


def requirement_findings(requirements: DataFrame) -> DataFrame:
    """Findings for requirement rows (database, four text fields) that break a rule."""
    def whole(name):
        return F.col(name).rlike(r"^-?[0-9]+$")

    def number(name):
        return F.col(name).try_cast("long")

    def broken(name, kind, message, when):
        return F.when(F.coalesce(when, F.lit(True)), F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("issue_type"),
            F.lit(message).alias("message"),
        ))

    limits = (
        ("retention_days", "NEGATIVE_VALUE", "must not be negative", lambda n: n < 0),
        ("max_duration_minutes", "NOT_POSITIVE", "must be above zero", lambda n: n <= 0),
        ("max_downtime_minutes", "NEGATIVE_VALUE", "must not be negative", lambda n: n < 0),
    )
    parts = []
    for name, kind, message, bad in limits:
        parts.append(broken(name, "NOT_AN_INTEGER", "must be an integer", ~whole(name)))
        parts.append(F.when(whole(name), broken(name, kind, message, bad(number(name)))))
    parts.append(broken(
        "archive_required", "NOT_A_BOOLEAN", "must be true or false",
        ~F.col("archive_required").isin("true", "false"),
    ))
    return as_findings(
        requirements.select("database", F.inline(F.array_compact(F.array(*parts))))
        .withColumn("severity", F.lit(rules.HIGH)),
        "REQUIREMENTS",
    )
