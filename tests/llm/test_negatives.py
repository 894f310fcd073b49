import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moveproof.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, scale=256.0, every=50, positives=5, count=3):
    seen, usable = set(), []
    for i, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(scale * float(np.float32(x))) for x in vector)
        if (i, label, whole) not in seen:
            seen.add((i, label, whole))
            usable.append((i, label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    last = lambda i: 1 << 63 if i is None else i
    out = []
    for a in usable:
        if a[0] is None or a[0] % every:
            continue
        ranked = sorted((-score(a, b), last(b[0]), b[1] == a[1], b[0]) for b in usable if b is not a)
        for s, _, _, p in [r for r in ranked if r[2]][:positives]:
            fits = [r for r in ranked if not r[2] and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(a[0], p, n + 1, r[3], -s, -r[0]) for n, r in enumerate(fits[:count])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def clustered(seed, n=700, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = []
    for i in range(n):
        vector = centres[rng.integers(9)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.4])
        rows.append((i, int(rng.integers(4)), [float(x) for x in vector / np.linalg.norm(vector)]))
    return rows


@pytest.mark.parametrize("sizes", [
    dict(sample=8192, chunk=8192, block=4096), dict(sample=200, chunk=40, block=4), dict(sample=64, chunk=300, block=1)])
def test_equals_brute_force(spark, sizes):
    rows = clustered(3)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(negatives.hard_negatives(table, F.col("id") % 50 == 0, **sizes)) == brute(rows)


def test_a_third_of_all_rows_alike_is_cut_into_chunks(spark):
    rows = clustered(5, 200) + [(1000 + i, i % 2, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0]) for i in range(120)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(negatives.hard_negatives(table, F.col("id") % 50 == 0, chunk=16, sample=80)) == brute(rows)


def test_edges(spark):
    odd = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [1.0, 0.5]), (None, 1, [0.9, 0.4]), (3, None, [1.0, 0.5]),
           (4, 1, None), (5, 1, [1.0, None]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]),
           (8, 1, [0.8]), (9, 2, [0.7, 0.2, 0.1]), (10, 2, []), (50, 3, [0.0, 0.0]), (11, 3, [0.0, 0.0, 0.0]),
           (12, 2, [0.6, 0.3]), (100, 4, [-1.0, 0.0]), (13, 4, [1.0, 0.0])]
    table = spark.createDataFrame(odd, SCHEMA).withColumn("key", F.lit("clash")).withColumn("leaf", F.lit(1))
    assert found(negatives.hard_negatives(table, F.col("id") % 50 == 0)) == brute(odd)
    empty = spark.createDataFrame([], SCHEMA)
    assert found(negatives.hard_negatives(empty, F.col("id") % 50 == 0)) == []
    huge = [(i, i % 2, [3e38 / (i + 1), 1e30]) for i in range(6)]
    got = negatives.hard_negatives(spark.createDataFrame(huge, SCHEMA), F.col("id") % 50 == 0).collect()
    assert all(abs(r.positive_score) <= 1 << 62 for r in got)


def test_ranges_pass_over_far_subtrees():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * np.concatenate([c + rng.normal(size=(500, 8)) * 0.01 for c in rng.normal(size=(6, 8))]))
    splits, leaves = negatives.grown(rows, 8, 100)
    ranges = negatives._open(splits)
    leaf = negatives.routed(splits, rows, ranges)
    exact = negatives.scores(rows[:40], rows)
    lo = np.partition(exact, -5, axis=1)[:, -5][:, None]
    looked = np.zeros((40, leaves), bool)
    for at, here in negatives.reached(splits, ranges, rows[:40], lo, np.full_like(lo, negatives.FAR)):
        looked[here, at] = True
    assert all(looked[q, leaf[r]] for q, r in zip(*np.nonzero(exact >= lo)))
    assert looked.mean() < 0.4


def test_query_equals_sql(spark, root):
    from compare import difference, duck
    from moveproof.llm.queries import ORACLES, QUERIES

    name = "op13_hard_negatives"
    assert difference(spark, duck(root), QUERIES[name], ORACLES[name], root) is None
