import pytest
from pyspark.sql import functions as F

from moveproof import rules
from moveproof.operators import advise, scoring

ZERO = {c: 0 for c, t in scoring.FLEET_COLUMNS.items() if t in ("long", "int")}
CALM = {**ZERO, "run_id": "r", "database": "d", "reconciliation_status": "EXECUTED",
        "growth_status": "ANALYZED", "overall_growth_rate_percent": 0.0, "archive_required": False}
SCHEMA = "run_id string, database string, " + ", ".join(
    f"{c} {t}" for c, t in scoring.FLEET_COLUMNS.items())


def assessed(spark, *changes):
    order = ["run_id", "database", *scoring.FLEET_COLUMNS]
    rows = [tuple({**CALM, "database": str(i), **c}[k] for k in order)
            for i, c in enumerate(changes)]
    got = scoring.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: int(r["database"]))]


def test_growth_risk(spark):
    cases = [(50.0, 15), (49.99, 10), (20.0, 10), (19.99, 5), (10.0, 5), (9.99, 0), (None, 0),
             (-80.0, 0)]
    got = assessed(spark, *[{"overall_growth_rate_percent": g} for g, _ in cases],
                   {"overall_growth_rate_percent": 90.0, "growth_status": "BASELINE_CREATED"})
    assert [r["growth_risk_score"] for r in got] == [s for _, s in cases] + [0]
    assert [r["growth_score"] for r in got] == [s for _, s in cases] + [0]


def test_retention_and_service_levels(spark):
    cases = [
        (2555, True, 0, 0, 10, 0, 0, 0), (2555, False, 0, 0, 5, 0, 0, 0),
        (1095, False, 31, 0, 5, 5, 3, 3), (1094, False, 30, 0, 0, 10, 0, 5),
        (0, True, 120, 5, 5, 10, 2, 8), (0, True, 121, 30, 5, 5, 2, 3),
        (2555, True, 30, 5, 10, 10, 7, 10), (0, False, 121, 31, 0, 0, 0, 0),
    ]
    got = assessed(spark, *[
        {"retention_days": d, "archive_required": a, "max_duration_minutes": m,
         "max_downtime_minutes": t} for d, a, m, t, *_ in cases])
    keys = ("retention_risk_score", "sla_risk_score", "retention_penalty", "sla_penalty")
    assert [tuple(r[k] for k in keys) for r in got] == [c[4:] for c in cases]


def test_downtime_decides_severity(spark):
    strict_then_mild, = assessed(spark, {"max_duration_minutes": 10, "max_downtime_minutes": 20})
    assert (strict_then_mild["sla_risk_score"], strict_then_mild["sla_severity"]) == (10, "MEDIUM")


def test_profiling_is_not_part_of_risk(spark):
    r, = assessed(spark, {"profiling_high": 9})
    assert (r["profiling_risk_score"], r["risk_score"], r["risk_level"]) == (90, 0, "LOW")
    assert r["profiling_penalty"] == 35


@pytest.mark.parametrize("score, level", [(50, "CRITICAL"), (48, "HIGH"), (25, "HIGH"),
                                          (24, "MEDIUM"), (10, "MEDIUM"), (9, "LOW")])
def test_risk_levels(spark, score, level):
    medium, low = divmod(score, 5)
    while low % 2:
        medium, low = medium - 1, low + 5
    r, = assessed(spark, {"reconciliation_medium": medium, "reconciliation_low": low // 2})
    assert (r["risk_score"], r["risk_level"]) == (score, level)


def test_complexity_caps_and_levels(spark):
    r, = assessed(spark, {
        "missing_target_datasets": 9, "extra_target_datasets": 9, "not_reconciled_datasets": 9,
        "total_rows": 10_000_000, "total_datasets": 100, "total_columns": 1000})
    assert (r["reconciliation_score"], r["complexity_score"], r["complexity_level"]) == (
        40, 115, "VERY_HIGH")
    calm, = assessed(spark, {})
    assert (calm["complexity_score"], calm["complexity_level"]) == (15, "LOW")


def test_unreachable_target_costs_nothing(spark):
    r, = assessed(spark, {"reconciliation_status": rules.NOT_EXECUTED, "reconciliation_high": 1})
    assert r["reconciliation_penalty"] == 0


def test_readiness_floor_and_status(spark):
    worst, calm = assessed(spark, {
        "profiling_high": 99, "reconciliation_high": 99, "retention_days": 3000,
        "archive_required": True, "max_duration_minutes": 1, "max_downtime_minutes": 1}, {})
    assert (worst["readiness_score"], worst["readiness_level"], worst["assessment_status"]) == (
        0, "NOT_READY", "ACTION_REQUIRED")
    assert (calm["readiness_score"], calm["assessment_status"]) == (100, "READY_FOR_NEXT_STAGE")


def test_advice_without_a_rule_is_dropped_unless_extended(spark):
    found = spark.createDataFrame(
        [("", "d", "t", "c", "PROFILING", "NULL_VALUES_OPTIONAL", "LOW", "m", 0),
         ("", "d", "t", "c", "PROFILING", "NULL_VALUES", "LOW", "m", 0)],
        "run_id string, database string, dataset string, column string, source string, "
        "issue_type string, severity string, message string, position int")
    assert [r["recommendation_id"] for r in advise.from_findings(found).collect()] == ["PROF-001"]
    assert advise.from_findings(found, extended=True).count() == 2


def test_governance(spark):
    def decision(rows):
        df = spark.createDataFrame(
            [("r", "d", "R", c, p, "t", "f", "s", "ds", None, i + 1)
             for i, (c, p) in enumerate(rows)],
            "run_id string, database string, recommendation_id string, category string, "
            "priority string, title string, finding string, source string, dataset string, "
            "column string, order_no long")
        return advise.governance(advise.action_plan(df)).first()["governance_decision"]

    assert decision([("DATA_QUALITY", "LOW")]) == "APPROVAL_WITH_ACTIONS"
    assert decision([("DATA_QUALITY", "HIGH")]) == "APPROVAL_BLOCKED"
    assert decision([("MIGRATION_COMPLETENESS", "LOW")]) == "APPROVAL_BLOCKED"


def test_owner_default(spark):
    df = spark.createDataFrame([("r", "d", "R", "UNCLASSIFIED", "LOW", "t", "f", "s", "ds", "c", 1)],
                               "run_id string, database string, recommendation_id string, "
                               "category string, priority string, title string, finding string, "
                               "source string, dataset string, column string, order_no long")
    row = advise.action_plan(df).first()
    assert (row["suggested_owner"], row["action_id"]) == ("MIGRATION_TEAM", "ACT-001")


def test_unknown_priority_sorts_last(rows):
    assert rows(["LOW", "CRITICAL", "?"], advise.priority_rank) == [4, 1, 99]


def test_levels_cover_every_fleet_row(spark, root):
    from moveproof.plans.variants import variant

    fleet = variant(spark, root, "fleet")
    out = scoring.assess(fleet)
    assert out.filter(F.col("assessment_status").isNull() | F.col("risk_level").isNull()).count() == 0
    assert advise.strategic(out).filter("recommendation_id = 'STRAT-003'").count() == fleet.count()
