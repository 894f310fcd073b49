import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof import rules
from moveproof.functions import types as ty

# --- fixed values: column of values -> detected type ---
DETECTED = [
    (["1", "-2", " 3 ", ""], "INTEGER"),
    (["1", "2.5"], "NUMERIC"),
    (["1.", "2"], "TEXT"),
    (["+1"], "TEXT"),
    (["2024-01-05", "2024-1-5"], "DATE"),
    (["2024-01-05", "2023-02-30"], "TEXT"),
    (["24-01-05"], "TEXT"),
    (["20240101"], "INTEGER"),
    (["2024-01-05 10:00:00", "2024-1-5  1:2:3"], "TIMESTAMP"),
    (["2024-01-05 10:00"], "TEXT"),
    (["2024-01-05 24:00:00"], "TEXT"),
    (["2024-01-05", "2024-01-05 10:00:00"], "TEXT"),
    (["", "  ", None], "TEXT"),
    (["\t7 ", "8"], "INTEGER"),
    (["1\n2"], "TEXT"),
]


@pytest.mark.parametrize("values, wanted", DETECTED)
def test_detection(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert ty.detect_types(df, "t").first()["detected_type"] == wanted


def test_physical_types(rows):
    for target, types in rules.PHYSICAL_TYPES.items():
        for spelling in (str, str.lower, lambda s: f" {s.title()} "):
            got = rows([spelling(k) for k in types], lambda c: ty.physical_type(c, target.lower()))
            assert got == list(types.values())
    assert rows(["JSONB", ""], lambda c: ty.physical_type(c, "mysql")) == [None, None]
    with pytest.raises(ValueError):
        ty.physical_type(F.lit("TEXT"), "oracle")


def test_selected_over_detected(spark):
    data = [("BIGINT", "INTEGER", "BIGINT"), (" ", "DATE", "DATE"), ("null", "DATE", "DATE"),
            (" NULL ", " ", "TEXT"), (None, None, "TEXT"), (" VARCHAR ", None, "VARCHAR")]
    df = spark.createDataFrame(data, "s string, d string, wanted string")
    got = df.select(ty.resolved_type(F.col("s"), F.col("d")).alias("t"), "wanted").collect()
    assert all(r["t"] == r["wanted"] for r in got)


def test_logical_types():
    pairs = [(T.IntegerType(), "INTEGER"), (T.LongType(), "BIGINT"), (T.DoubleType(), "NUMERIC"),
             (T.DecimalType(10, 2), "NUMERIC"), (T.DateType(), "DATE"),
             (T.TimestampNTZType(), "TIMESTAMP"), (T.BooleanType(), "BOOLEAN"),
             (T.StringType(), "TEXT"), (T.ArrayType(T.LongType()), "TEXT")]
    assert [ty.logical_type(t) for t, _ in pairs] == [w for _, w in pairs]


def test_hints(rows):
    names = ["ID", "Email", "joindate", "PRICE", "phone", "other"]
    assert rows(names, ty.hinted_type) == ["INT", "VARCHAR(255)", "DATETIME", "DECIMAL(10,2)",
                                           "VARCHAR(20)", "VARCHAR(255)"]
    assert rows(names, ty.hinted_key) == [True] + [False] * 5


def test_casts_never_fail(rows):
    assert rows(["5", "x", " 6 ", None], lambda c: ty.cast_to(c, "INTEGER")) == [5, None, 6, None]
    assert rows(["true", "maybe"], lambda c: ty.cast_to(c, "BOOLEAN")) == [True, None]
    assert rows(["2024", "2024-1-5", "2024-02-30", "2024-01-05 10:00:00"],
                lambda c: ty.cast_to(c, "DATE").cast("string")) == [None, "2024-01-05", None, None]
    assert rows(["2024", "2024-01-05", "2024-01-05 1:02:03", "2024-01-05T10:00:00.5"],
                lambda c: ty.cast_to(c, "TIMESTAMP").cast("string")) == [
        None, "2024-01-05 00:00:00", "2024-01-05 01:02:03", "2024-01-05 10:00:00.5"]


def fits(value, pattern):
    try:
        datetime.strptime(value, pattern)
        return True
    except ValueError:
        return False


def brute_force(values):
    """The detection rules in plain Python, for random columns."""
    held = [v.strip() for v in values if v.strip()]
    if not held:
        return "TEXT"
    if all(re.fullmatch(r"-?[0-9]+", v) for v in held):
        return "INTEGER"
    if all(re.fullmatch(r"-?[0-9]+([.][0-9]+)?", v) for v in held):
        return "NUMERIC"
    for name, pattern in (("DATE", "%Y-%m-%d"), ("TIMESTAMP", "%Y-%m-%d %H:%M:%S")):
        if all(fits(v, pattern) for v in held):
            return name
    return "TEXT"


def test_detection_against_brute_force(spark):
    rng = random.Random(7)
    pools = [
        ["1", "-5", "007", " 12 ", ""], ["1.5", "2", "-0.25", "\u00a03"],
        ["2024-01-05", "2024-1-5", "1999-12-31", " "],
        ["2024-01-05 10:00:00", "2024-1-5 1:2:3", "2024-01-05\t10:00:00"],
        ["2024-02-29", "2023-02-29", "0000-01-01", "2024-13-01", "2024-00-10", "99-01-01"],
        ["2024-01-05 23:59:60", "2024-01-05 10:60:00", "2024-01-05 10:00"],
        ["-", ".", "-.5", "5.", "1e5", "abc", "--1", "1-2", "1:2", "\x1c4"], ["", "  ", "\u2003"],
    ]
    columns = []
    for _ in range(120):
        pool = rng.choice(pools) + (rng.choice(pools) if rng.random() < 0.3 else [])
        columns.append([rng.choice(pool) for _ in range(rng.randint(1, 6))])
    height = max(map(len, columns))
    data = [tuple(c[i] if i < len(c) else "" for c in columns) for i in range(height)]
    df = spark.createDataFrame(data, ", ".join(f"c{i} string" for i in range(len(columns))))
    got = {r["column"]: r["detected_type"] for r in ty.detect_types(df, "t").collect()}
    wrong = {f"c{i}": (c, got[f"c{i}"], brute_force(c)) for i, c in enumerate(columns)
             if got[f"c{i}"] != brute_force(c)}
    assert not wrong
