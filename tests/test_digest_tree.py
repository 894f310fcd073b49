import glob
import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moveproof.operators import digest_tree as dt
from moveproof.operators import snapshot


def statuses(df):
    return {tuple(r[:-3]): tuple(r[-3:]) for r in df.collect()}


def both(spark, before, after, keys, tmp_path):
    paths = str(tmp_path / "a"), str(tmp_path / "b")
    for df, path in zip((before, after), paths):
        dt.write_snapshot(df, keys, path)
    return paths, before.select(*keys).schema


@pytest.fixture
def orders(spark, root):
    return spark.read.parquet(f"{root}/orders.parquet")


def changed(orders, by):
    key = F.col("o_orderkey")
    price = F.when(key % by == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.filter(key % (3 * by) != 1).withColumn("o_totalprice", price)


def test_same_keys_as_a_full_comparison(spark, orders, tmp_path):
    later = changed(orders, 10).select(*reversed(orders.columns))
    (a, b), keys = both(spark, orders, later, ["o_orderkey"], tmp_path)
    wanted = {k: v for k, v in statuses(snapshot.change_status(orders, later, ["o_orderkey"])).items() if v[0] != "UNCHANGED"}
    assert statuses(dt.changed_keys(spark, a, b, keys)) == wanted
    assert {v[0] for v in wanted.values()} == {"CHANGED", "DELETED"}


def test_equal_ranges_are_not_read(spark, orders, tmp_path):
    """The folders of equal leaves are taken away before the comparison, which still gives the same."""
    later = changed(orders, 300)
    (a, b), keys = both(spark, orders, later, ["o_orderkey"], tmp_path)
    wanted = {k: v for k, v in statuses(snapshot.change_status(orders, later, ["o_orderkey"])).items() if v[0] != "UNCHANGED"}
    leaves, compared = dt.differing_leaves(spark, a, b)
    assert 0 < len(leaves) <= len(wanted) and compared[0] == 1
    assert compared[-1] < orders.count() / 10
    needed = {leaf >> (dt.LEAF_BITS - dt.FOLDER_BITS) for leaf in leaves}
    gone = 0
    for folder in glob.glob(f"{tmp_path}/*/rows/_folder=*"):
        if int(folder.rsplit("=", 1)[1]) not in needed:
            gone += 1
            for file in os.listdir(folder):
                with open(f"{folder}/{file}", "wb") as f:
                    f.write(b"unreadable")
    assert gone > dt.FOLDER_BITS
    assert statuses(dt.changed_keys(spark, a, b, keys)) == wanted


def test_equal_and_empty_snapshots(spark, orders, tmp_path):
    (a, b), keys = both(spark, orders, orders.repartition(7), ["o_orderkey"], tmp_path)
    assert dt.differing_leaves(spark, a, b) == ([], [1])
    assert dt.changed_keys(spark, a, b, keys).count() == 0
    none = str(tmp_path / "none")
    dt.write_snapshot(orders.limit(0), ["o_orderkey"], none)
    assert dt.differing_leaves(spark, none, none) == ([], [0])
    assert {v[0] for v in statuses(dt.changed_keys(spark, none, a, keys)).values()} == {"NEW"}
    assert dt.changed_keys(spark, a, none, keys).count() == orders.count()


def test_repeated_rows_null_keys_and_nesting(spark, tmp_path):
    rows = [(None, "x", {"a": 1, "b": None}), (1, None, {"b": 2, "a": 1}), (1, None, {"a": 1, "b": 2}), (2, "é|", {}),
            (3, "same", None)]
    schema = "k long, v string, m map<string,int>"
    before = spark.createDataFrame(rows, schema)
    after = spark.createDataFrame([rows[0], rows[1], (2, "é", {}), rows[4], (None, "x", {"b": None, "a": 1})], schema)
    (a, b), keys = both(spark, before, after, ["k"], tmp_path)
    got = {k[0]: v for k, v in statuses(dt.changed_keys(spark, a, b, keys)).items()}
    assert got == {None: ("CHANGED", 1, 2), 1: ("CHANGED", 2, 1), 2: ("CHANGED", 1, 1)}


def test_values_that_print_alike_stay_apart(spark):
    one = spark.createDataFrame([("a|1:b", "c", None)], "k string, v string, w string")
    two = spark.createDataFrame([("a", "1:b|c", "~")], "k string, v string, w string")
    roots = [r for df in (one, two) for r in dt.digest_tree(df, ["k"]).filter("level = 0").select(*dt.SUMS).collect()]
    assert roots[0] != roots[1]


def test_tree_is_the_sum_of_its_rows(spark):
    rows = [(i % 9, f"v{i}") for i in range(60)]
    tree = dt.digest_tree(spark.createDataFrame(rows, "k long, v string").repartition(4), ["k"])
    got = {(r.level, r.node): (r.n_rows, r.s0, r.s3) for r in tree.collect()}
    text = lambda v: f"{len(str(v))}:{v}"
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    wanted = {}
    for k, v in rows:
        leaf, row = int(md5(text(k))[:4], 16), md5(f"{text(k)}|{text(v)}")
        for level in range(5):
            wanted.setdefault((level, leaf >> (16 - 4 * level)), Counter()).update(
                n=1, s0=int(row[:8], 16), s3=int(row[24:], 16))
    assert got == {k: (c["n"], c["s0"], c["s3"]) for k, c in wanted.items()}
