import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moveproof.functions import text as tx
from moveproof.functions.rates import grade, growth_rate, match_share, share
from moveproof.operators import findings as fnd
from moveproof.operators import keys as k
from moveproof.operators import profile as p
from moveproof import rules

NAN = float("nan")


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_missing_values_and_distinct(spark):
    df = spark.createDataFrame(
        [(1, NAN, "a", [1], {"x": 1, "y": 2}), (2, None, "a", [1], {"y": 2, "x": 1}),
         (2, 0.0, None, [2], None), (None, -0.0, "b", None, {"x": 3})],
        "i int, d double, s string, a array<int>, m map<string,int>",
    )
    got = by_column(p.profile_columns({"t": df}))
    assert {c: (r["null_count"], r["unique_value_count"]) for c, r in got.items()} == {
        "i": (1, 2), "d": (2, 1), "s": (1, 2), "a": (1, 2), "m": (1, 2)}
    assert got["i"]["uniqueness_percentage"] == 66.67 and got["d"]["null_percentage"] == 50.0


def test_all_types_are_profiled(spark):
    df = spark.sql("""SELECT cast(1 AS tinyint) a, true b, date'2024-01-01' c, timestamp'2024-01-01' d,
        timestamp_ntz'2024-01-01' e, cast(1.5 AS decimal(10,2)) f, X'00' g,
        named_struct('z', 1, 'y', array(1)) h, cast('NaN' AS float) i, parse_json('{"b":1,"a":2}') j""")
    got = by_column(p.profile_columns({"t": df}))
    assert len(got) == 10 and got["i"]["null_count"] == 1
    assert all(r["unique_value_count"] == 1 for c, r in got.items() if c != "i")
    near = by_column(p.profile_columns({"t": df}, exact=False))
    assert all(near[c]["unique_value_count"] == r["unique_value_count"] for c, r in got.items())


def test_empty_table(spark):
    empty = {"t": spark.createDataFrame([], "a int, b string")}
    columns, duplicates = p.profile_columns(empty), p.duplicate_rows(empty)
    assert [r["total_rows"] for r in columns.collect()] == [0, 0]
    row = duplicates.first()
    assert (row["total_rows"], row["duplicate_rows"], row["duplicate_percentage"]) == (0, 0, 0.0)
    issues = p.profiling_issues(columns, duplicates).collect()
    assert [(i["issue_type"], i["severity"]) for i in issues] == [("EMPTY_DATASET", "HIGH")]


def test_duplicates_agree_with_pandas(spark, root):
    for name in ("labels", "orders", "lineitem"):
        df = spark.read.parquet(f"{root}/{name}.parquet")
        df = df.unionByName(df.filter(F.col(df.columns[0]) % 7 == 0))
        want = int(df.toPandas().duplicated().sum())
        assert p.duplicate_rows({name: df}).first()["duplicate_rows"] == want


def test_distinct_agrees_with_pandas(spark, root):
    df = spark.read.parquet(f"{root}/events.parquet").withColumn(
        "value", F.when(F.col("event_id") % 9 == 0, None)
        .when(F.col("event_id") % 13 == 0, NAN).otherwise(F.col("value")))
    pdf = pd.read_parquet(f"{root}/events.parquet")
    pdf.loc[(pdf.event_id % 9 == 0) | (pdf.event_id % 13 == 0), "value"] = None
    got = by_column(p.profile_columns({"e": df}))
    for c in pdf.columns:
        assert got[c]["null_count"] == int(pdf[c].isnull().sum())
        assert got[c]["unique_value_count"] == int(pdf[c].nunique())


def test_duplicates_and_distinct_add_up_with_a_hot_row(spark):
    """A third of all rows are one row; distinct rows plus duplicates are all rows."""
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 500)).otherwise("y").alias("b"))
    row = p.duplicate_rows({"t": df}).first()
    assert row["duplicate_rows"] + df.distinct().count() == row["total_rows"] == 30000
    kept = p.keep_first(df, ["b"], ["a"]).collect()
    assert {(r["a"], r["b"][0], r["copies"]) for r in kept} == {(0, "x", 10000), (1, "y", 20000)}


def test_long_text_is_compared_whole(spark):
    head = "word " * 2000
    df = spark.createDataFrame([(head + "a",), (head + "b",), (head + "a",)], "t string")
    assert p.duplicate_rows({"t": df}).first()["duplicate_rows"] == 1
    assert p.profile_columns({"t": df}).first()["unique_value_count"] == 2


def test_digest_is_not_a_value(spark):
    long = "z" * 64
    df = spark.createDataFrame([(long,)], "t string")
    digest = df.select(F.sha2("t", 256)).first()[0]
    both = spark.createDataFrame([(long,), (digest,)], "t string")
    assert p.profile_columns({"t": both}).first()["unique_value_count"] == 2


# thresholds on both sides of every boundary
@pytest.mark.parametrize("value, scale, label", [
    (10.0, rules.DUPLICATE_SEVERITY, "HIGH"), (9.99, rules.DUPLICATE_SEVERITY, "MEDIUM"),
    (80.0, rules.NULL_SEVERITY, "HIGH"), (79.99, rules.NULL_SEVERITY, "MEDIUM"),
    (30.0, rules.NULL_SEVERITY, "MEDIUM"), (29.99, rules.NULL_SEVERITY, "LOW"),
    (89.99, rules.ROW_MATCH_SEVERITY, "HIGH"), (90.0, rules.ROW_MATCH_SEVERITY, "MEDIUM"),
    (98.99, rules.ROW_MATCH_SEVERITY, "MEDIUM"), (99.0, rules.ROW_MATCH_SEVERITY, "LOW"),
])
def test_grades(rows, value, scale, label):
    assert rows([value], lambda c: grade(c, scale), "double") == [label]


def test_rates(spark):
    one = spark.range(1)
    got = one.select(
        share(F.lit(1), F.lit(3)), share(F.lit(0), F.lit(0)),
        growth_rate(F.lit(0), F.lit(0)), growth_rate(F.lit(0), F.lit(5)),
        growth_rate(F.lit(4), F.lit(5)), match_share(F.lit(0), F.lit(0)),
        match_share(F.lit(0), F.lit(9)), match_share(F.lit(8), F.lit(9)),
    ).first()
    assert list(got) == [33.33, 0.0, 0.0, None, 25.0, 100.0, 0.0, 88.89]


def test_semantics_decide_null_findings(spark):
    n = 100
    df = spark.range(n).select(
        F.when(F.col("id") < 4, F.col("id")).alias("a"),
        F.when(F.col("id") < 5, F.col("id")).alias("b"),
        F.when(F.col("id") < 6, F.col("id")).alias("c"),
        F.when(F.col("id") < 20, F.col("id")).alias("d"),
        F.when(F.col("id") < 71, F.col("id")).alias("e"), F.lit(1).alias("f"),
        F.when(F.col("id") < 50, F.col("id")).alias("g"),
    )
    sem = spark.createDataFrame(
        [("t", "a", "optional"), ("t", "b", "optional"), ("t", "c", "optional"),
         ("t", "d", "required"), ("t", "e", "business_key"), ("t", "g", "nullable")],
        "dataset string, column string, semantic string")
    issues = p.profiling_issues(p.profile_columns({"t": df}), p.duplicate_rows({"t": df}), sem)
    got = {(r["column"], r["issue_type"], r["severity"]) for r in issues.collect()
           if r["issue_type"] != "DUPLICATE_ROWS"}
    assert got == {("c", "NULL_VALUES_OPTIONAL", "LOW"), ("d", "NULL_VALUES", "HIGH"),
                   ("e", "NULL_VALUES", "LOW"), ("f", "CONSTANT_COLUMN", "LOW")}


def test_key_rules(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (None, None), (None, None), (2, None)], "x int, y string")
    row = k.key_measures(df, ["x", "y"]).first()
    assert (row["total_rows"], row["null_key_cells"], row["repeated_key_rows"]) == (5, 5, 4)
    found = {r["issue_type"]: r["affected_records"]
             for r in k.check_primary_key(df, "t", ["x"]).collect()}
    assert found == {"PRIMARY_KEY_NULL": 2, "PRIMARY_KEY_DUPLICATE": 4}
    lost = k.check_primary_key(df, "t", ["x", "z"]).first()
    assert (lost["issue_type"], lost["column"], lost["affected_records"]) == (
        "PRIMARY_KEY_MISSING_COLUMNS", "z", 5)


def test_orphans_with_a_hot_key(spark):
    child = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 10).alias("k"))
    parent = spark.range(10).select(F.col("id").alias("k"))
    relation = {"name": "c -> p", "child": child, "child_key": "k", "parent": parent,
                "parent_key": "k", "child_name": "c"}
    row = k.fk_orphans([relation]).first()
    assert (row["orphan_rows"], row["orphan_keys"]) == (3000, 1)
    blind = {**relation, "parent": parent.union(spark.sql("SELECT cast(null AS bigint)"))}
    assert k.fk_orphans([blind]).first()["orphan_rows"] == 3000
    assert k.fk_orphans([blind], null_aware=True).first()["orphan_rows"] == 0


def test_custom_checks_count_nulls_as_failures(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    row = fnd.run_checks(df, "t", [("POSITIVE", "HIGH", "must be positive", F.col("v") > 0)]).first()
    assert (row["affected_records"], row["affected_percentage"]) == (2, 66.67)


def test_canonical_json(spark):
    df = spark.sql("""SELECT named_struct('b', map('y', 1, 'x', 2), 'a', array(named_struct('d', 1, 'c', 2))) s
        UNION ALL SELECT named_struct('b', map('x', 2, 'y', 1), 'a', array(named_struct('d', 1, 'c', 2)))""")
    got = {r[0] for r in df.select(tx.canonical_json(F.col("s"), df.schema["s"].dataType)).collect()}
    assert got == {'{"a":[{"c":2,"d":1}],"b":{"x":2,"y":1}}'}


def test_display_formats(rows):
    assert rows([0.5, 59.999, 61.0, 3725.5, None], tx.show_duration, "double") == [
        "0.50 seconds", "60.00 seconds", "1 min 1.00 sec", "1 hr 2 min 5.50 sec", "N/A"]
    assert rows([10, 2048, 5 * 1024 ** 2, 3 * 1024 ** 4, 2048 * 1024 ** 4, None], tx.show_bytes,
                "long") == ["10.00 B", "2.00 KB", "5.00 MB", "3.00 TB", "2048.00 TB", "-"]
    assert rows([1234567, None], tx.show_number, "long") == ["1,234,567", "-"]
    assert rows([12.345, 0.125, None], tx.show_percentage, "double") == [
        "12.35%", "0.12%", "-"]


def test_iso_text(spark):
    df = spark.createDataFrame(
        [(datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 600)),
         (None, datetime.datetime(2024, 1, 2, 3, 4, 5))], "d date, t timestamp_ntz")
    assert [tuple(r) for r in tx.json_safe(df).collect()] == [
        ("2024-01-02", "2024-01-02T03:04:05.000600"), (None, "2024-01-02T03:04:05")]


def test_sketch_is_close(spark, root):
    exact = by_column(p.profile_columns({"l": spark.read.parquet(f"{root}/lineitem.parquet")}))
    near = by_column(p.profile_columns(
        {"l": spark.read.parquet(f"{root}/lineitem.parquet")}, exact=False))
    for c, row in exact.items():
        assert near[c]["null_count"] == row["null_count"]
        assert math.isclose(near[c]["unique_value_count"], row["unique_value_count"], rel_tol=0.15)


def test_first_rows_of_tables_with_maps(spark):
    from moveproof.operators import drift

    df = spark.sql("SELECT id % 2 AS k, id AS n, map('a', id) AS m FROM range(6)")
    got = {r["k"]: (r["n"], r["m"], r["copies"]) for r in p.keep_first(df, ["k"], ["n"]).collect()}
    assert got == {0: (0, {"a": 0}, 3), 1: (1, {"a": 1}, 3)}
    last = {r["k"]: r["m"] for r in drift.latest_per_key(df, ["k"], ["n"]).collect()}
    assert last == {0: {"a": 4}, 1: {"a": 5}}
