"""The one findings layout and what is computed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof import rules

FINDING_COLUMNS = {
    "run_id": "string", "database": "string", "dataset": "string", "column": "string",
    "source": "string", "issue_type": "string", "severity": "string",
    "affected_records": "long", "affected_percentage": "double",
    "expected": "double", "actual": "double", "message": "string", "position": "int",
}


def as_findings(df: DataFrame, source: str | None = None, run_id: str | None = None) -> DataFrame:
    """Any partial findings frame in the full layout; absent columns become null."""
    given = set(df.columns)
    out = []
    for name, dtype in FINDING_COLUMNS.items():
        if name == "source" and source is not None:
            col = F.lit(source)
        elif name == "run_id" and run_id is not None:
            col = F.lit(run_id)
        else:
            col = F.col(name) if name in given else F.lit(None)
        out.append(col.cast(dtype).alias(name))
    return df.select(*out)


def issue_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per key by severity."""
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_issues"),
        *[
            F.count_if(F.col("severity") == s).alias(f"{s.lower()}_severity_issues")
            for s in (rules.HIGH, rules.MEDIUM, rules.LOW)
        ],
    )


def run_checks(df: DataFrame, dataset: str, checks: list[tuple], database: str = "source"):
    """Custom checks: (name, severity, message, Column that is true for a good row).

    All checks are counted in one pass over the table; a null verdict is a failure.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"bad{i}")
          for i, (_, _, _, c) in enumerate(checks)],
    )
    rows = F.inline(F.array(*[
        F.struct(F.lit(name).alias("issue_type"), F.lit(sev).alias("severity"),
                 F.lit(msg).alias("message"), F.col(f"bad{i}").alias("affected_records"))
        for i, (name, sev, msg, _) in enumerate(checks)
    ]))
    failed = counted.select("n", rows).filter(F.col("affected_records") > 0)
    return as_findings(failed.select(
        "*", F.lit(database).alias("database"), F.lit(dataset).alias("dataset"),
        F.round(F.lit(100.0) * F.col("affected_records") / F.col("n"), 2)
        .alias("affected_percentage"),
    ), "PROFILING")
