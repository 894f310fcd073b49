import pytest
from pyspark.sql import functions as F

from moveproof.operators import reconcile as rec
from moveproof.operators import snapshot as snap
from moveproof.sources.catalog import (
    create_count_function, create_sample_view, table_inventory, tables_without,
)

INVENTORY = "dataset string, record_count long, column_count int"


def test_a_table_agrees_with_itself(spark, root):
    frames = {t: spark.read.parquet(f"{root}/{t}.parquet") for t in ("orders", "nation")}
    inventory = table_inventory({**frames, "DatabaseChangeLog": frames["nation"]})
    assert inventory.count() == 2
    sides = rec.reconcile(inventory, inventory)
    assert {r["status"] for r in sides.collect()} == {"RECONCILED"}
    assert rec.reconciliation_issues(sides).count() == 0


@pytest.mark.parametrize("expected, actual, severity", [
    (10000, 8999, "HIGH"), (10000, 9000, "MEDIUM"), (10000, 9899, "MEDIUM"), (10000, 9900, "LOW"),
    (9000, 10000, "MEDIUM"), (0, 5, "HIGH"), (5, 0, "HIGH"),
])
def test_row_severity(spark, expected, actual, severity):
    sides = rec.reconcile(spark.createDataFrame([("T", expected, 3)], INVENTORY),
                          spark.createDataFrame([("t", actual, 3)], INVENTORY))
    issue = rec.reconciliation_issues(sides).first()
    assert (issue["issue_type"], issue["severity"]) == ("ROW_COUNT_MISMATCH", severity)


@pytest.mark.parametrize("gap, kind, severity", [
    (2, "COLUMN_COUNT_MISMATCH_MINOR", "MEDIUM"), (-2, "COLUMN_COUNT_MISMATCH_MINOR", "MEDIUM"),
    (3, "COLUMN_COUNT_MISMATCH", "HIGH"), (-3, "COLUMN_COUNT_MISMATCH", "HIGH"),
])
def test_column_severity(spark, gap, kind, severity):
    sides = rec.reconcile(spark.createDataFrame([("t", 5, 10)], INVENTORY),
                          spark.createDataFrame([("t", 5, 10 + gap)], INVENTORY))
    issue = rec.reconciliation_issues(sides).first()
    assert (issue["issue_type"], issue["severity"]) == (kind, severity)


def test_change_status_adds_up(spark):
    before = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    now = before.filter("k >= 10").withColumn("v", F.when(F.col("k") % 9 == 0, -1)
                                              .otherwise(F.col("v"))).union(
        spark.range(200, 205).select("id", F.lit(1).cast("long")))
    got = {r["change_status"]: r["count"] for r in
           snap.change_status(before, now, ["k"]).groupBy("change_status").count().collect()}
    assert got["NEW"] + got["CHANGED"] + got["UNCHANGED"] == now.count()
    assert got["DELETED"] + got["CHANGED"] + got["UNCHANGED"] == before.count()
    assert (got["NEW"], got["DELETED"], got["CHANGED"]) == (5, 10, 10)


def test_moved_null_and_repeats_are_changes(spark):
    schema = "k int, a string, b string"
    before = spark.createDataFrame([(1, "x", None), (2, "p", "p"), (2, "p", "p"), (3, None, None),
                                    (None, "n", "n")], schema)
    now = spark.createDataFrame([(1, None, "x"), (2, "q", "q"), (2, "q", "q"), (3, None, None),
                                 (None, "n", "n")], schema)
    got = {r["k"]: r["change_status"] for r in snap.change_status(before, now, ["k"]).collect()}
    assert got == {1: "CHANGED", 2: "CHANGED", 3: "UNCHANGED", None: "UNCHANGED"}


def test_nulls_moved_inside_nested_values_are_changes(spark):
    schema = "k int, a array<int>, s struct<x: string, y: string>, m map<string,int>"
    before = spark.createDataFrame(
        [(1, [1, None], None, None), (2, [], ("p", None), {"a": 1, "b": 2}),
         (3, None, None, {"a": None})], schema)
    now = spark.createDataFrame(
        [(1, [None, 1], None, None), (2, [], ("p", None), {"b": 2, "a": 1}),
         (3, None, None, {})], schema)
    got = {r["k"]: r["change_status"] for r in snap.change_status(before, now, ["k"]).collect()}
    assert got == {1: "CHANGED", 2: "UNCHANGED", 3: "CHANGED"}


def test_fingerprint_ignores_order_only(spark, root):
    df = spark.read.parquet(f"{root}/orders.parquet")
    of = lambda d: snap.table_fingerprint(d, "t").first()["fingerprint"]
    assert of(df) == of(df.orderBy(F.desc("o_totalprice")).repartition(7))
    assert of(df) != of(df.filter("o_orderkey <> 5"))
    assert of(df) != of(df.withColumn("o_custkey", F.when(F.col("o_orderkey") == 5, 0)
                                      .otherwise(F.col("o_custkey"))))
    assert of(df) != of(df.union(df.filter("o_orderkey = 5")))


def test_growth_cases(spark):
    schema = "database string, dataset string, record_count long"
    before = spark.createDataFrame([("d", "gone", 42), ("d", "same", 5), ("d", "more", 4),
                                    ("d", "less", 4), ("d", "zero", 0), ("d", "rise", 0)], schema)
    now = spark.createDataFrame([("d", "same", 5), ("d", "more", 5), ("d", "less", 3),
                                 ("d", "zero", 0), ("d", "rise", 7), ("d", "born", 1),
                                 ("e", "first", 9)], schema)
    growth = snap.dataset_growth(before, now)
    got = {(r["database"], r["dataset"]): (r["status"], r["growth_rate_percent"])
           for r in growth.collect()}
    assert got == {
        ("d", "gone"): ("REMOVED_DATASET", -100.0), ("d", "same"): ("NO_CHANGE", 0.0),
        ("d", "more"): ("GROWTH", 25.0), ("d", "less"): ("REDUCTION", -25.0),
        ("d", "zero"): ("NO_CHANGE", 0.0), ("d", "rise"): ("GROWTH", None),
        ("d", "born"): ("NEW_DATASET", None), ("e", "first"): ("NEW_DATASET", None)}
    summary = {r["database"]: r for r in snap.growth_summary(growth).collect()}
    assert summary["e"]["growth_status"] == "BASELINE_CREATED"
    assert summary["e"]["new_datasets"] == 0 and summary["e"]["current_total_records"] == 9
    assert summary["d"]["overall_growth_rate_percent"] == round(100 * (21 - 55) / 55, 2)


def test_count_function_and_view(spark, root):
    df = spark.read.parquet(f"{root}/part.parquet")
    assert spark.sql(f"SELECT {create_count_function(spark, 'part', df)}()").first()[0] == df.count()
    view = spark.table(create_sample_view(df, "part", ["p_partkey"]))
    assert [r["p_partkey"] for r in view.collect()] == list(range(10))
    assert tables_without({"part": df}, "created_at") == ["part"]
