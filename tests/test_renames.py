import random

from pyspark.sql import functions as F

from moveproof.operators import drift, inclusion
from moveproof.session import literal_rows


def test_most_alike_first_and_no_column_twice(spark):
    old = spark.createDataFrame([(i, i % 10, float(i), i % 2 == 0) for i in range(40)], "Id long, a long, r double, f boolean")
    new = spark.createDataFrame([(i, i % 10, float(i), i % 2 == 0, i % 10, 7) for i in range(2, 40)],
                                "ID long, b long, real double, flag boolean, c long, empty long").withColumn(
        "empty", F.lit(None).cast("long"))
    got = inclusion.renamed_columns({"t": old, "gone": old}, {"t": new, "fresh": new})
    assert got == [("t", "a", "b", 10, 10, 10), ("t", "f", "flag", 2, 2, 2), ("t", "r", "real", 38, 40, 38)]


def test_equal_to_a_walk_over_all_pairs(spark):
    rng = random.Random(8)
    sets = {c: {rng.randrange(30) for _ in range(rng.choice([8, 15, 25]))} for c in "abcdefghij"}
    frame = lambda names: spark.createDataFrame(
        [tuple(sorted(sets[c])[i % len(sets[c])] for c in names) for i in range(60)], ", ".join(f"{c} long" for c in names))
    got = inclusion.renamed_columns({"t": frame("abcde")}, {"t": frame("fghij")}, min_similarity=0.2)
    pairs = sorted((-len(sets[a] & sets[b]) / len(sets[a] | sets[b]), i, j, a, b)
                   for i, a in enumerate("abcde") for j, b in enumerate("fghij"))
    used, wanted = set(), set()
    for s, _, _, a, b in pairs:
        if -s >= 0.2 and not {a, b} & used:
            used |= {a, b}
            wanted.add((a, b))
    assert {r[1:3] for r in got} == wanted


def test_renames_replace_an_added_and_a_removed_row(spark):
    before = literal_rows(spark, "table string, column string", [("t", "A"), ("t", "b"), ("t", "c")])
    after = literal_rows(spark, "table string, column string", [("t", "a2"), ("t", "B"), ("t", "d")])
    renames = literal_rows(spark, "table string, old string, new string", [("t", "A", "a2"), ("other", "c", "d")])
    got = sorted(map(tuple, drift.with_renames(drift.column_changes(before, after), renames).collect()), key=str)
    assert got == [("t", "a", "RENAMED", "a2"), ("t", "c", "REMOVED", None), ("t", "d", "ADDED", None)]


def test_nothing_changed(spark):
    df = spark.range(3)
    assert inclusion.renamed_columns({"t": df}, {"t": df}) == []
