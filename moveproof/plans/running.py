"""Run history, durations, job health and report-input queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof.operators import history as hist
from moveproof.plans.registry import query
from moveproof.plans.variants import variant, with_variants
from moveproof.session import table

SECONDS = "round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2)"


@query("stage_durations", with_variants("run_events") + f"""
SELECT run_id, stage, min(ts) AS started, max(ts) AS ended,
       arg_max(status, (ts, event_no)) AS status, {SECONDS} AS duration_seconds
FROM run_events GROUP BY run_id, stage""")
def stage_durations(spark, root):
    return hist.stage_durations(variant(spark, root, "run_events"))


@query("run_durations", with_variants("run_events") + f"""
SELECT run_id, min(ts) AS started, max(ts) AS ended, count(DISTINCT stage) AS stages,
       CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'FAILED' ELSE 'SUCCESS' END
         AS final_status,
       arg_min(stage, (ts, event_no)) FILTER (WHERE status = 'FAILED') AS failed_stage,
       {SECONDS} AS duration_seconds FROM run_events GROUP BY run_id""")
def run_durations(spark, root):
    return hist.run_durations(variant(spark, root, "run_events")).drop("duration_text")


RECORDS = """SELECT CASE WHEN event_id % 2 = 0 THEN 'MySQL' ELSE 'mysql' END AS database,
       event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'Linux' END AS operating_system,
       concat('job_', CAST(user_id AS STRING)) AS job_name,
       concat('b', CAST(event_id % 3 AS STRING)) AS build_number, ts, event_id, value AS duration
FROM {events}"""


@query("run_history_latest", f"""WITH records AS (
{RECORDS.replace('STRING', 'VARCHAR').replace('{events}', 'events')}),
ranked AS (SELECT lower(database) AS database, lower(action) AS action,
  lower(coalesce(operating_system, '')) AS operating_system, job_name, build_number, ts, event_id,
  duration, row_number() OVER (PARTITION BY lower(database), lower(action),
    lower(coalesce(operating_system, '')), job_name, build_number
    ORDER BY ts DESC, event_id DESC) AS rn FROM records)
SELECT database, action, operating_system, job_name, build_number, ts, event_id, duration
FROM ranked WHERE rn = 1""")
def run_history_latest(spark, root):
    records = spark.sql(RECORDS, events=table(spark, root, "events"))
    return hist.latest_runs(records, ["ts", "event_id"]).orderBy(F.desc("ts"), F.desc("event_id"))


def jobs(spark, root):
    events = table(spark, root, "events")
    ids = events.select(
        F.col("user_id").alias("job"), (F.col("user_id") % 5 != 0).alias("enabled")
    ).distinct()
    runs = events.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").alias("job"), F.col("ts").alias("run_ts")
    )
    schedules = events.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("job"), F.format_string("s%d", F.col("event_id") % 10)
        .alias("schedule"), (F.col("event_id") % 4 == 0).alias("enabled"),
    )
    return ids, runs, schedules


@query("job_health", """
SELECT j.job, j.enabled, r.last_run, coalesce(r.runs, 0) AS runs, s.next_schedule
FROM (SELECT DISTINCT user_id AS job, user_id % 5 <> 0 AS enabled FROM events) j
LEFT JOIN (SELECT user_id AS job, max(ts) AS last_run, count(*) AS runs FROM events
           WHERE event_type IN ('purchase', 'error') GROUP BY user_id) r ON r.job = j.job
LEFT JOIN (SELECT user_id AS job, min(concat('s', event_id % 10)) AS next_schedule FROM events
           WHERE event_type = 'signup' AND event_id % 4 = 0 GROUP BY user_id) s ON s.job = j.job""")
def job_health(spark, root):
    return hist.job_health(*jobs(spark, root))


@query("job_totals", """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE enabled) AS enabled_jobs,
       count(*) FILTER (WHERE NOT enabled) AS disabled_jobs
FROM (SELECT DISTINCT user_id, user_id % 5 <> 0 AS enabled FROM events) j""")
def job_totals(spark, root):
    return hist.job_totals(jobs(spark, root)[0])


ARTIFACTS = """SELECT r AS report, concat('db_', CAST(r % 4 AS STRING)) AS database,
  CASE WHEN event_id % 61 = 0 THEN 'db_x' ELSE concat('db_', CAST(r % 4 AS STRING)) END
    AS artifact_database,
  CASE WHEN r % 5 = 0 THEN NULL WHEN r % 5 = 1 AND event_id % 4 = 0 THEN NULL
       WHEN r % 5 = 2 THEN concat('b', CAST(event_id % 2 AS STRING)) WHEN r % 5 = 3 THEN 'b0'
       ELSE 'b1' END AS build
FROM (SELECT event_id, CAST(floor(event_id / 4) AS BIGINT) AS r FROM {events}) e"""


@query("artifact_consistency", f"""WITH a AS (
{ARTIFACTS.replace('STRING', 'VARCHAR').replace('{events}', 'events')})
SELECT report, count(*) AS artifacts, count(build) AS tagged_artifacts,
  count(DISTINCT build) AS builds,
  count(*) FILTER (WHERE artifact_database <> database) AS foreign_artifacts,
  CASE WHEN count(*) FILTER (WHERE artifact_database <> database) > 0 THEN 'MISMATCHED_DATABASE'
       WHEN count(build) = 0 THEN 'UNVERIFIED_LEGACY' WHEN count(build) < count(*)
       THEN 'MIXED_PROVENANCE' WHEN count(DISTINCT build) > 1 THEN 'MISMATCHED_BUILD'
       WHEN min(build) <> 'b1' THEN 'STALE' ELSE 'VERIFIED' END AS provenance
FROM a GROUP BY report""")
def artifact_consistency(spark, root):
    artifacts = spark.sql(ARTIFACTS, events=table(spark, root, "events"))
    return hist.artifact_consistency(artifacts, "b1")
