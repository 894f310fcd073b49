"""Scores of a fleet of databases, and the way from findings to a decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof import rules
from moveproof.operators import advise, scoring
from moveproof.operators import profile as p
from moveproof.operators import reconcile as rec
from moveproof.operators import snapshot as snap
from moveproof.operators.history import executive_summary as summary_row
from moveproof.operators.profile import union_all
from moveproof.plans import reconciling as r
from moveproof.plans.profiling import ISSUE_DATASETS
from moveproof.plans.registry import query
from moveproof.plans.variants import Inputs, variant, with_variants
from moveproof.session import stored, table

# --- the scores as SQL over a table named fleet ------------------------------------------
ASSESS_CTES = """
risk1 AS (SELECT f.*,
  profiling_high * 10 + profiling_medium * 5 + profiling_low * 2 AS profiling_risk_score,
  reconciliation_high * 10 + reconciliation_medium * 5 + reconciliation_low * 2
    AS reconciliation_risk_score,
  CASE WHEN growth_status = 'BASELINE_CREATED' OR overall_growth_rate_percent IS NULL THEN 0
       WHEN overall_growth_rate_percent >= 50 THEN 15 WHEN overall_growth_rate_percent >= 20 THEN 10
       WHEN overall_growth_rate_percent >= 10 THEN 5 ELSE 0 END AS growth_risk_score,
  CASE WHEN retention_days >= 2555 AND archive_required THEN 10
       WHEN retention_days >= 1095 OR archive_required THEN 5 ELSE 0 END AS retention_risk_score,
  CASE WHEN max_duration_minutes <= 0 THEN 0 WHEN max_duration_minutes <= 30 THEN 10
       WHEN max_duration_minutes <= 120 THEN 5 ELSE 0 END AS duration_points,
  CASE WHEN max_downtime_minutes <= 0 THEN 0 WHEN max_downtime_minutes <= 5 THEN 10
       WHEN max_downtime_minutes <= 30 THEN 5 ELSE 0 END AS downtime_points
  FROM fleet f),
risk2 AS (SELECT *, greatest(duration_points, downtime_points) AS sla_risk_score,
  CASE WHEN growth_risk_score >= 10 THEN 'HIGH' WHEN growth_risk_score = 5 THEN 'MEDIUM'
       ELSE 'LOW' END AS growth_severity,
  CASE retention_risk_score WHEN 10 THEN 'HIGH' WHEN 5 THEN 'MEDIUM' ELSE 'LOW' END
    AS retention_severity,
  CASE WHEN downtime_points = 10 THEN 'HIGH' WHEN downtime_points = 5 THEN 'MEDIUM'
       WHEN duration_points = 10 THEN 'HIGH' WHEN duration_points = 5 THEN 'MEDIUM' ELSE 'LOW' END
    AS sla_severity,
  CASE WHEN max_duration_minutes > 0 OR max_downtime_minutes > 0 THEN 'CONFIGURED'
       ELSE 'NOT_APPLICABLE' END AS sla_status FROM risk1),
risk3 AS (SELECT *, growth_risk_score + retention_risk_score + sla_risk_score
    AS discovery_risk_score,
  reconciliation_risk_score + growth_risk_score + retention_risk_score + sla_risk_score
    AS risk_score FROM risk2),
risk AS (SELECT *, CASE WHEN risk_score >= 50 THEN 'CRITICAL' WHEN risk_score >= 25 THEN 'HIGH'
  WHEN risk_score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  profiling_high + reconciliation_high
    + CASE WHEN growth_severity = 'HIGH' THEN 1 ELSE 0 END
    + CASE WHEN retention_severity = 'HIGH' THEN 1 ELSE 0 END
    + CASE WHEN sla_severity = 'HIGH' THEN 1 ELSE 0 END AS risk_high_issues,
  profiling_medium + reconciliation_medium
    + CASE WHEN growth_severity = 'MEDIUM' THEN 1 ELSE 0 END
    + CASE WHEN retention_severity = 'MEDIUM' THEN 1 ELSE 0 END
    + CASE WHEN sla_severity = 'MEDIUM' THEN 1 ELSE 0 END AS risk_medium_issues,
  profiling_low + reconciliation_low AS risk_low_issues FROM risk3),
complexity1 AS (SELECT *,
  CASE WHEN total_rows >= 10000000 THEN 30 WHEN total_rows >= 1000000 THEN 20
       WHEN total_rows >= 100000 THEN 10 ELSE 5 END AS volume_score,
  CASE WHEN total_datasets >= 100 THEN 25 WHEN total_datasets >= 50 THEN 20
       WHEN total_datasets >= 20 THEN 15 WHEN total_datasets >= 10 THEN 10 ELSE 5 END
    AS dataset_score,
  CASE WHEN total_columns >= 1000 THEN 20 WHEN total_columns >= 500 THEN 15
       WHEN total_columns >= 200 THEN 10 ELSE 5 END AS width_score,
  CAST(least(missing_target_datasets * 5, 15) + least(extra_target_datasets * 2, 10)
    + least(not_reconciled_datasets * 3, 15) AS INTEGER) AS reconciliation_score,
  CASE WHEN growth_status <> 'ANALYZED' OR overall_growth_rate_percent IS NULL THEN 0
       WHEN overall_growth_rate_percent >= 50 THEN 15 WHEN overall_growth_rate_percent >= 20 THEN 10
       WHEN overall_growth_rate_percent >= 10 THEN 5 ELSE 0 END AS growth_score FROM risk),
complexity2 AS (SELECT *, volume_score + dataset_score + width_score + reconciliation_score
  + growth_score AS complexity_score FROM complexity1),
complexity AS (SELECT *, CASE WHEN complexity_score >= 70 THEN 'VERY_HIGH'
  WHEN complexity_score >= 45 THEN 'HIGH' WHEN complexity_score >= 20 THEN 'MEDIUM' ELSE 'LOW' END
  AS complexity_level FROM complexity2),
ready1 AS (SELECT *,
  CAST(least(profiling_high * 8 + profiling_medium * 4 + profiling_low, 35) AS INTEGER)
    AS profiling_penalty,
  CAST(CASE WHEN reconciliation_status = 'NOT_EXECUTED_DATABASE_REQUIRED' THEN 0
    ELSE least(reconciliation_high * 10 + reconciliation_medium * 5 + reconciliation_low * 2
      + missing_target_datasets * 5 + not_reconciled_datasets * 3, 45) END AS INTEGER)
    AS reconciliation_penalty,
  CASE risk_level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 5 WHEN 'HIGH' THEN 10 ELSE 15 END
    AS risk_penalty,
  CASE complexity_level WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 6 ELSE 10 END
    AS complexity_penalty,
  CASE WHEN sla_status = 'NOT_APPLICABLE' THEN 0 ELSE
    CASE WHEN retention_days >= 2555 THEN 5 WHEN retention_days >= 1095 THEN 3 ELSE 0 END
    + CASE WHEN archive_required THEN 2 ELSE 0 END END AS retention_penalty,
  CASE duration_points WHEN 10 THEN 5 WHEN 5 THEN 3 ELSE 0 END
    + CASE downtime_points WHEN 10 THEN 5 WHEN 5 THEN 3 ELSE 0 END AS sla_penalty
  FROM complexity),
ready2 AS (SELECT *, profiling_penalty + reconciliation_penalty + risk_penalty + complexity_penalty
  + retention_penalty + sla_penalty AS total_penalty FROM ready1),
ready3 AS (SELECT *, greatest(0, 100 - total_penalty) AS readiness_score FROM ready2),
ready AS (SELECT *, CASE WHEN readiness_score >= 85 THEN 'READY'
  WHEN readiness_score >= 65 THEN 'READY_WITH_CONDITIONS'
  WHEN readiness_score >= 40 THEN 'NEEDS_REMEDIATION' ELSE 'NOT_READY' END AS readiness_level
  FROM ready3),
assessed AS (SELECT *, CASE WHEN risk_level = 'CRITICAL' OR readiness_level = 'NOT_READY'
  THEN 'ACTION_REQUIRED' WHEN readiness_level = 'NEEDS_REMEDIATION' THEN 'REMEDIATION_REQUIRED'
  WHEN readiness_level = 'READY_WITH_CONDITIONS' THEN 'CONDITIONAL_APPROVAL'
  ELSE 'READY_FOR_NEXT_STAGE' END AS assessment_status FROM ready)"""

FLEET = with_variants("fleet") + "," + ASSESS_CTES


def fleet(spark, root):
    return variant(spark, root, "fleet")


RISK_COLUMNS = ("database", "profiling_risk_score", "reconciliation_risk_score",
                "growth_risk_score", "retention_risk_score", "sla_risk_score", "sla_status",
                "discovery_risk_score", "risk_score", "risk_level", "risk_high_issues",
                "risk_medium_issues", "risk_low_issues")
COMPLEXITY_COLUMNS = ("database", "volume_score", "dataset_score", "width_score",
                      "reconciliation_score", "growth_score", "complexity_score",
                      "complexity_level")
READINESS_COLUMNS = ("database", "profiling_penalty", "reconciliation_penalty", "risk_penalty",
                     "complexity_penalty", "retention_penalty", "sla_penalty", "total_penalty",
                     "readiness_score", "readiness_level")


@query("risk_score", FLEET + f" SELECT {', '.join(RISK_COLUMNS)} FROM risk")
def risk_score(spark, root):
    return scoring.risk(fleet(spark, root)).select(*RISK_COLUMNS)


FACTORS = " UNION ALL ".join(
    [f"SELECT run_id, database, '{s.upper()}' AS source, '{v}' AS severity, "
     f"{s}_{v.lower()} AS issue_count FROM risk WHERE {s}_{v.lower()} > 0"
     for s in ("profiling", "reconciliation") for v in ("HIGH", "MEDIUM")]
    + [f"SELECT run_id, database, 'DISCOVERY_{s.upper()}', {s}_severity, 1 FROM risk "
       f"WHERE {s}_risk_score > 0" for s in ("growth", "retention", "sla")]
)


@query("risk_factors", FLEET + " " + FACTORS)
def risk_factors(spark, root):
    return scoring.risk_factors(scoring.risk(fleet(spark, root)))


@query("complexity_score", FLEET + f" SELECT {', '.join(COMPLEXITY_COLUMNS)} FROM complexity")
def complexity_score(spark, root):
    return scoring.complexity(fleet(spark, root)).select(*COMPLEXITY_COLUMNS)


@query("readiness_score", FLEET + f" SELECT {', '.join(READINESS_COLUMNS)} FROM ready")
def readiness_score(spark, root):
    return scoring.assess(fleet(spark, root)).select(*READINESS_COLUMNS)


@query("complexity_factors", FLEET + """
SELECT run_id, database, 'DATA_VOLUME' AS factor, volume_score AS score,
       CAST(total_rows AS DOUBLE) AS observed_value FROM complexity
UNION ALL SELECT run_id, database, 'DATASET_COUNT', dataset_score, total_datasets FROM complexity
UNION ALL SELECT run_id, database, 'SCHEMA_WIDTH', width_score, total_columns FROM complexity
UNION ALL SELECT run_id, database, 'RECONCILIATION_FINDINGS', reconciliation_score,
  missing_target_datasets + extra_target_datasets + not_reconciled_datasets FROM complexity
  WHERE reconciliation_score > 0
UNION ALL SELECT run_id, database, 'DATABASE_GROWTH', growth_score, overall_growth_rate_percent
  FROM complexity WHERE growth_score > 0""")
def complexity_factors(spark, root):
    return scoring.complexity_factors(scoring.complexity(fleet(spark, root)))


@query("readiness_factors", FLEET + " " + " UNION ALL ".join(
    f"SELECT run_id, database, '{name}' AS factor, {c} AS penalty FROM ready WHERE {c} > 0"
    + (" OR reconciliation_status = 'NOT_EXECUTED_DATABASE_REQUIRED'"
       if name == "RECONCILIATION" else "")
    for c, name in scoring.READINESS_FACTORS.items()))
def readiness_factors(spark, root):
    return scoring.readiness_factors(scoring.assess(fleet(spark, root)))


@query("assessment_status", FLEET + """
SELECT database, risk_level, complexity_level, readiness_level, assessment_status FROM assessed""")
def assessment_status(spark, root):
    return scoring.assess(fleet(spark, root)).select(
        "database", "risk_level", "complexity_level", "readiness_level", "assessment_status"
    )


STRATEGIC_CTE = """
strategic AS (
SELECT run_id, database, 'STRAT-001' AS recommendation_id, 'MIGRATION_RISK' AS category,
       risk_level AS priority, 'Reduce Migration Risk' AS title,
       concat('risk level is ', risk_level) AS finding, 0 AS seq
FROM assessed WHERE risk_level IN ('HIGH', 'CRITICAL')
UNION ALL
SELECT run_id, database, 'STRAT-002', 'MIGRATION_COMPLEXITY', 'HIGH',
       'Apply Enhanced Migration Controls', concat('complexity level is ', complexity_level), 1
FROM assessed WHERE complexity_level IN ('HIGH', 'VERY_HIGH')
UNION ALL
SELECT run_id, database, 'STRAT-003', 'MIGRATION_READINESS',
       CASE readiness_level WHEN 'READY' THEN 'LOW' WHEN 'READY_WITH_CONDITIONS' THEN 'MEDIUM'
            ELSE 'HIGH' END,
       CASE readiness_level WHEN 'READY' THEN 'Proceed to Next Migration Stage'
            WHEN 'READY_WITH_CONDITIONS' THEN 'Proceed with Defined Conditions'
            ELSE 'Complete Remediation Before Approval' END,
       concat('readiness level is ', readiness_level), 2
FROM assessed)"""

PRIORITY_RANK = "CASE priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 " \
                "WHEN 'LOW' THEN 4 ELSE 99 END"


@query("strategic_recommendations", FLEET + "," + STRATEGIC_CTE + """
SELECT database, recommendation_id, category, priority, title, finding FROM strategic""")
def strategic_recommendations(spark, root):
    return advise.strategic(scoring.assess(fleet(spark, root))).select(
        "database", "recommendation_id", "category", "priority", "title", "finding"
    )


@query("governance_decision", FLEET + "," + STRATEGIC_CTE + """
SELECT run_id, database,
  CASE WHEN count(*) FILTER (WHERE priority IN ('CRITICAL', 'HIGH')) > 0 THEN 'APPROVAL_BLOCKED'
       ELSE 'APPROVAL_WITH_ACTIONS' END AS governance_decision,
  count(*) AS total_actions, count(*) AS open_actions,
  count(*) FILTER (WHERE priority IN ('CRITICAL', 'HIGH')) AS blocking_actions,
  count(*) FILTER (WHERE priority = 'CRITICAL') AS critical_actions,
  count(*) FILTER (WHERE priority = 'HIGH') AS high_actions,
  count(*) FILTER (WHERE priority = 'MEDIUM') AS medium_actions,
  count(*) FILTER (WHERE priority = 'LOW') AS low_actions
FROM strategic GROUP BY run_id, database""")
def governance_decision(spark, root):
    advice = advise.strategic(scoring.assess(fleet(spark, root)))
    return advise.governance(advise.action_plan(advice.withColumn("order_no", F.col("seq") + 1)))


# --- from findings to a decision, over the given tables --------------------------------------
# the inventory of the run before: fewer events and documents, lines before they were repeated
EARLIER = {"d_events": "SELECT count(*) AS n FROM {events} WHERE event_id % 10 <> 0",
           "d_lineitem": "SELECT count(*) AS n FROM {lineitem}",
           "documents": "SELECT count(*) AS n FROM {documents} WHERE doc_id % 8 <> 0",
           "labels": "SELECT count(*) AS n FROM {labels}"}
# what the source's owner asks for, as text, the retention from the span of the orders
REQUIREMENT_SQL = """SELECT 'source' AS database, CAST({days} AS STRING) AS retention_days,
'true' AS archive_required, '60' AS max_duration_minutes, '15' AS max_downtime_minutes FROM {orders}"""


def earlier_inventory(spark, root):
    names = ("events", "lineitem", "documents", "labels")
    given = {n: table(spark, root, n) for n in names}
    return union_all(
        spark.sql(sql, **{n: df for n, df in given.items() if "{" + n + "}" in sql}).select(
            F.lit("source").alias("database"), F.lit(dataset).alias("dataset"),
            F.col("n").alias("record_count")) for dataset, sql in EARLIER.items())


def requirements(spark, root):
    sql = REQUIREMENT_SQL.replace("{days}", "datediff(max(o_orderdate), min(o_orderdate))")
    return spark.sql(sql, orders=table(spark, root, "orders"))


def measured(spark, root):
    """Findings, and the measured tables as one fleet row with their growth and requirements.

    Every measurement is stored when it is taken, so the tables are scanned
    once however many scores and lists are drawn from it.
    """
    inputs = Inputs(spark, root, *r.FINDING_INPUTS)
    duplicates = stored(p.duplicate_rows(inputs.only(*ISSUE_DATASETS)), "duplicates")
    sides = stored(r.reconciled(inputs), "reconciled")
    found = stored(r.findings(inputs, duplicates, sides), "findings")
    totals = duplicates.groupBy("database").agg(
        F.sum("total_rows").alias("total_rows"), F.count(F.lit(1)).alias("total_datasets"),
        F.sum("total_columns").cast("long").alias("total_columns"),
    )
    profiling = F.col("source") == "PROFILING"
    counts = found.groupBy("database").agg(*[
        F.count_if(side & (F.col("severity") == s)).alias(f"{prefix}_{s.lower()}")
        for prefix, side in (("profiling", profiling), ("reconciliation", ~profiling))
        for s in (rules.HIGH, rules.MEDIUM, rules.LOW)
    ])
    states = rec.reconciliation_summary(sides, rec.reconciliation_issues(sides)).select(
        "database", "reconciliation_status", "reconciled_datasets", "missing_target_datasets",
        "extra_target_datasets", "not_reconciled_datasets",
    )
    fleet_row = totals.join(states, "database").join(counts, "database", "left").fillna(0)
    current = duplicates.select("database", "dataset", F.col("total_rows").alias("record_count"))
    growth = stored(snap.growth_summary(snap.dataset_growth(earlier_inventory(spark, root), current)).select(
        "database", "growth_status", "overall_growth_rate_percent"), "growth")
    needs = stored(scoring.parsed_requirements(requirements(spark, root)), "requirements")
    return found, fleet_row.join(growth, "database", "left").join(needs, "database", "left").withColumn(
        "run_id", F.lit(""))


RULE_ROWS = ", ".join(
    f"('{s}', '{t}', '{pre}', '{c}', '{title}', {advise.issue_order(t)})"
    for s, t, pre, c, title in rules.RECOMMENDATION_RULES
)

GROWTH_SQL = " UNION ALL ".join(
    f"SELECT '{dataset}' AS dataset, n FROM ({sql.replace('{', '').replace('}', '')}) x"
    for dataset, sql in EARLIER.items())

DECISION_CTES = r.FINDINGS_CTES + f""",
earlier AS ({GROWTH_SQL}),
grown AS (SELECT CASE WHEN count(*) FILTER (WHERE e.dataset IS NOT NULL) > 0 THEN 'ANALYZED'
                      ELSE 'BASELINE_CREATED' END AS growth_status,
    round(100.0 * (sum(coalesce(d.total_rows, 0)) - sum(coalesce(e.n, 0))) / sum(coalesce(e.n, 0)), 2) AS rate
  FROM dups d FULL OUTER JOIN earlier e ON d.dataset = e.dataset),
needs AS ({REQUIREMENT_SQL.replace('STRING', 'VARCHAR').replace('{orders}', 'orders').replace(
    '{days}', "date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)")}),
fleet AS (
SELECT '' AS run_id, 'source' AS database,
  (SELECT count(*) FROM all_findings WHERE source = 'PROFILING' AND severity = 'HIGH')
    AS profiling_high,
  (SELECT count(*) FROM all_findings WHERE source = 'PROFILING' AND severity = 'MEDIUM')
    AS profiling_medium,
  (SELECT count(*) FROM all_findings WHERE source = 'PROFILING' AND severity = 'LOW')
    AS profiling_low,
  (SELECT count(*) FROM all_findings WHERE source <> 'PROFILING' AND severity = 'HIGH')
    AS reconciliation_high,
  (SELECT count(*) FROM all_findings WHERE source <> 'PROFILING' AND severity = 'MEDIUM')
    AS reconciliation_medium,
  (SELECT count(*) FROM all_findings WHERE source <> 'PROFILING' AND severity = 'LOW')
    AS reconciliation_low,
  'EXECUTED' AS reconciliation_status,
  (SELECT count(*) FROM reconciled WHERE status = 'RECONCILED') AS reconciled_datasets,
  (SELECT count(*) FROM reconciled WHERE status = 'MISSING_TARGET_DATASET')
    AS missing_target_datasets,
  (SELECT count(*) FROM reconciled WHERE status = 'EXTRA_TARGET_DATASET') AS extra_target_datasets,
  (SELECT count(*) FROM reconciled WHERE status IN ('MISSING_TARGET_DATASET', 'NOT_RECONCILED'))
    AS not_reconciled_datasets,
  (SELECT growth_status FROM grown) AS growth_status,
  (SELECT rate FROM grown) AS overall_growth_rate_percent,
  (SELECT CAST(retention_days AS INTEGER) FROM needs) AS retention_days,
  (SELECT archive_required = 'true' FROM needs) AS archive_required,
  (SELECT CAST(max_duration_minutes AS INTEGER) FROM needs) AS max_duration_minutes,
  (SELECT CAST(max_downtime_minutes AS INTEGER) FROM needs) AS max_downtime_minutes,
  (SELECT CAST(sum(total_rows) AS BIGINT) FROM dups) AS total_rows,
  (SELECT count(*) FROM dups) AS total_datasets,
  (SELECT CAST(sum(total_columns) AS BIGINT) FROM dups) AS total_columns),
{ASSESS_CTES},
{STRATEGIC_CTE},
rule_rows(source, issue_type, prefix, category, title, issue_order) AS (VALUES {RULE_ROWS}),
advised AS (SELECT f.*, r.prefix, r.category, r.title, r.issue_order,
  row_number() OVER (PARTITION BY r.prefix ORDER BY f.dataset, r.issue_order, f.position) AS n
  FROM all_findings f JOIN rule_rows r ON r.source = f.source AND r.issue_type = f.issue_type),
merged AS (
SELECT printf('%s-%03d', prefix, n) AS recommendation_id, category, severity AS priority, title,
       message AS finding, source, dataset, "column",
       CASE prefix WHEN 'PROF' THEN 1 ELSE 2 END AS block, n AS seq FROM advised
UNION ALL
SELECT recommendation_id, category, priority, title, finding, 'ASSESSMENT', '', NULL, 3, seq
FROM strategic),
recommended AS (SELECT '' AS run_id, 'source' AS database, *,
  row_number() OVER (ORDER BY {PRIORITY_RANK}, block, seq) AS order_no FROM merged)"""


def recommended(spark, root):
    found, fleet_row = measured(spark, root)
    return advise.recommendations(found, scoring.assess(fleet_row))


RECOMMENDATION_COLUMNS = ("database", "recommendation_id", "category", "priority", "title",
                          "finding", "source", "dataset", "column", "order_no")
QUOTED = {"column": '"column"'}


@query("recommendations", DECISION_CTES + f"""
SELECT {", ".join(QUOTED.get(c, c) for c in RECOMMENDATION_COLUMNS)} FROM recommended""")
def recommendations(spark, root):
    return recommended(spark, root).select(*RECOMMENDATION_COLUMNS)


OWNER_SQL = "CASE category " + " ".join(
    f"WHEN '{c}' THEN '{o}'" for c, o in rules.OWNERS.items()) + " ELSE 'MIGRATION_TEAM' END"
BLOCKING_SQL = ("(priority IN ('CRITICAL', 'HIGH') OR category IN "
                "('MIGRATION_COMPLETENESS', 'SCHEMA_RECONCILIATION'))")


@query("action_plan", DECISION_CTES + f"""
SELECT run_id, database, printf('ACT-%03d', order_no) AS action_id, recommendation_id, title,
  category, priority, {OWNER_SQL} AS suggested_owner, {BLOCKING_SQL} AS approval_blocking,
  CASE WHEN {BLOCKING_SQL} THEN 'MUST_RESOLVE_BEFORE_APPROVAL' ELSE 'REVIEW_AND_TRACK' END
    AS resolution_requirement,
  'OPEN' AS action_status, dataset, "column", finding, source FROM recommended""")
def action_plan(spark, root):
    return advise.action_plan(recommended(spark, root))


@query("executive_summary", DECISION_CTES + """
SELECT a.database, a.assessment_status, a.risk_level, a.complexity_level, a.readiness_score,
  a.readiness_level, a.total_datasets AS total_source_datasets, a.total_rows AS total_source_rows,
  a.profiling_high + a.profiling_medium + a.profiling_low AS total_data_quality_issues,
  a.reconciled_datasets, a.not_reconciled_datasets, a.missing_target_datasets,
  a.extra_target_datasets,
  (SELECT count(*) FROM recommended) AS total_recommendations,
  (SELECT count(*) FROM recommended WHERE priority = 'CRITICAL') AS critical_recommendations,
  (SELECT count(*) FROM recommended WHERE priority = 'HIGH') AS high_recommendations
FROM assessed a""")
def executive_summary(spark, root):
    found, fleet_row = measured(spark, root)
    assessed = stored(scoring.assess(fleet_row), "assessed")
    counts = advise.recommendation_counts(advise.unordered(found, assessed))
    return summary_row(assessed, counts)


@query("governance_recommended", DECISION_CTES + f"""
SELECT run_id, database,
  CASE WHEN count(*) FILTER (WHERE {BLOCKING_SQL}) > 0 THEN 'APPROVAL_BLOCKED'
       WHEN count(*) > 0 THEN 'APPROVAL_WITH_ACTIONS' ELSE 'APPROVAL_READY' END AS governance_decision,
  count(*) AS total_actions, count(*) AS open_actions,
  count(*) FILTER (WHERE {BLOCKING_SQL}) AS blocking_actions,
  count(*) FILTER (WHERE priority = 'CRITICAL') AS critical_actions,
  count(*) FILTER (WHERE priority = 'HIGH') AS high_actions,
  count(*) FILTER (WHERE priority = 'MEDIUM') AS medium_actions,
  count(*) FILTER (WHERE priority = 'LOW') AS low_actions
FROM recommended GROUP BY run_id, database""")
def governance_recommended(spark, root):
    """The decision on the recommendations themselves, with the category rule and their numbers."""
    return advise.governance(advise.action_plan(recommended(spark, root)))
