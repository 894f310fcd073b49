"""Run events, job health, run history and consistency of report inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.functions.text import show_duration
from moveproof.operators.drift import latest_per_key


def stage_durations(events: DataFrame) -> DataFrame:
    """Start, end, seconds and last status per (run_id, stage) of events (…, ts, event_no, status)."""
    return events.groupBy("run_id", "stage").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.max_by("status", F.struct("ts", "event_no")).alias("status"),
    ).withColumn("duration_seconds", _seconds("started", "ended"))


def _seconds(start: str, end: str):
    """Elapsed seconds to two places; from the interval, so zoneless times ignore clock changes."""
    gap = F.col(end) - F.col(start)
    units = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    total = sum((F.extract(F.lit(u), gap).cast("double") * n for u, n in units), F.lit(0.0))
    return F.round(total, 2)


def run_durations(events: DataFrame) -> DataFrame:
    """One row per run: duration, final status, and the first stage that failed."""
    failed = F.col("status") == "FAILED"
    moment = F.struct("ts", "event_no")
    return events.groupBy("run_id").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.count_distinct("stage").alias("stages"),
        F.when(F.count_if(failed) > 0, "FAILED").otherwise("SUCCESS").alias("final_status"),
        F.min_by("stage", F.when(failed, moment)).alias("failed_stage"),
    ).withColumn("duration_seconds", _seconds("started", "ended")).withColumn(
        "duration_text", show_duration(F.col("duration_seconds"))
    )


def latest_runs(records: DataFrame, order: list[str]) -> DataFrame:
    """Run history with one record per identity: the last one written, newest first.

    Database, action and operating system compare without case; job and build as given.
    """
    folded = records.withColumns(
        {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("database", "action", "operating_system")}
    )
    keys = ["database", "action", "operating_system", "job_name", "build_number"]
    return latest_per_key(folded, keys, order)


def job_health(jobs: DataFrame, runs: DataFrame, schedules: DataFrame) -> DataFrame:
    """Last run and first active schedule per job.

    Runs and schedules are folded to one row per job before they are joined,
    so jobs x runs x schedules never multiply out.
    """
    last = runs.groupBy("job").agg(F.max("run_ts").alias("last_run"),
                                   F.count(F.lit(1)).alias("runs"))
    following = schedules.filter("enabled").groupBy("job").agg(
        F.min("schedule").alias("next_schedule")
    )
    return jobs.join(last, "job", "left").join(following, "job", "left").select(
        "job", "enabled", "last_run", F.coalesce("runs", F.lit(0)).alias("runs"), "next_schedule"
    )


def job_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if("enabled").alias("enabled_jobs"),
        F.count_if(~F.col("enabled")).alias("disabled_jobs"),
    )


def artifact_consistency(artifacts: DataFrame, current_build: str | None = None) -> DataFrame:
    """Whether the inputs of each report fit together.

    Input (report, database, artifact_database, build). Checked in order:
    foreign database, no provenance at all, partly tagged, several builds, stale.
    """
    tagged = F.count("build")
    total = F.count(F.lit(1))
    foreign = F.count_if(F.col("artifact_database") != F.col("database"))
    stale = F.lit(False) if current_build is None else F.min("build") != current_build
    return artifacts.groupBy("report").agg(
        total.alias("artifacts"), tagged.alias("tagged_artifacts"),
        F.count_distinct("build").alias("builds"), foreign.alias("foreign_artifacts"),
        F.when(foreign > 0, "MISMATCHED_DATABASE").when(tagged == 0, "UNVERIFIED_LEGACY")
        .when(tagged < total, "MIXED_PROVENANCE")
        .when(F.min("build") != F.max("build"), "MISMATCHED_BUILD")
        .when(stale, "STALE").otherwise("VERIFIED").alias("provenance"),
    )


def expected_objects(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Deployed objects against generated and custom ones, per object type.

    Inputs (object_type, name, origin) and (object_type, name); names compare
    without case. PASS when nothing is missing.
    """
    want = expected.select("object_type", F.lower("name").alias("name"), "origin").distinct()
    have = actual.select("object_type", F.lower("name").alias("name"), F.lit(1).alias("found"))
    checked = want.join(have.distinct(), ["object_type", "name"], "left")
    lost = F.col("found").isNull()
    return checked.groupBy("object_type").agg(
        F.count_distinct(F.col("name")).alias("expected_objects"),
        F.count_distinct(F.when(lost, F.col("name"))).alias("missing_objects"),
        F.count_if(lost & (F.col("origin") == "generated")).alias("missing_generated"),
        F.count_if(lost & (F.col("origin") == "custom")).alias("missing_custom"),
        F.when(F.count_if(lost) == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def executive_summary(assessed: DataFrame, recommended: DataFrame) -> DataFrame:
    """Headline measures per (run, database) from assessment rows and recommendation counts."""
    issues = F.col("profiling_high") + F.col("profiling_medium") + F.col("profiling_low")
    counts = ("total_recommendations", "critical_recommendations", "high_recommendations")
    return assessed.join(recommended, ["run_id", "database"], "left").select(
        "database", "assessment_status", "risk_level", "complexity_level", "readiness_score",
        "readiness_level", F.col("total_datasets").alias("total_source_datasets"),
        F.col("total_rows").alias("total_source_rows"),
        issues.alias("total_data_quality_issues"), "reconciled_datasets",
        "not_reconciled_datasets", "missing_target_datasets", "extra_target_datasets",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
    )
