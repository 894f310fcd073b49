import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moveproof.llm import site_quality as Q, words as W
from moveproof.llm.queries import QUERIES


def test_measures_per_text():
    texts = ["A b. b b | %%%", "", None, " ".join(f"Word{i}." for i in range(100))]
    got = Q.measures(W.texts_of(pa.array(texts)))
    assert got.shape == (4, len(Q.FEATURES)) and (got[1] == got[2]).all() and (got[1] == 0).all()
    named = dict(zip(Q.FEATURES, got[0]))
    assert named["repeats"] == int((1 / 6) ** 0.5 * 16) and named["distinct"] == int((5 / 6) ** 0.5 * 16)
    assert named["bare_marks"] == int((2 / 6) ** 0.5 * 16) and named["length"] == 2
    assert got[3][Q.FEATURES.index("distinct")] == 15


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        host = rng.choice(["good", "bad", "mixed", "mixed", "mixed"])
        good = rng.random() < {"good": 0.97, "bad": 0.2, "mixed": 0.7}[host]
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 60))]
        if not good and rng.random() < 0.8:
            words = [w + rng.choice(["%%%", "$$$", "|"]) for w in words]
        rows.append((i, " ".join(words), host, rng.choice("ab")))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return rows, labels


def classified(spark, rows, labels, held=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    return Q.classify(docs, known, F.col("doc_id") % 3 == 1 if held is None else held).collect()


def test_held_out_accuracy_and_site_order(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in classified(spark, rows, labels)}
    held = [(got[i].kept, bool(y)) for i, y in labels if i % 3 == 1]
    assert sum(k == y for k, y in held) >= 0.85 * len(held)
    by_host = {h: np.mean([r.site_posterior for r in got.values() if r.host == h]) for h in ("good", "mixed", "bad")}
    assert by_host["good"] > by_host["mixed"] > by_host["bad"]


def test_sparse_sites_shrink_towards_their_host(spark):
    rows = [(h, "p", float(i % 5 > 0)) for h in ("a", "b", "c") for i in range(200)]
    rows += [("a", "rare", 0.0), ("zero", "p", 0.0)] + [("d", "p", 0.0)] * 150
    sites = spark.createDataFrame(rows, "host string, path string, credit double")
    got = {(r["_host"], r["_path"]): r["posterior"] for r in Q.site_posteriors(sites).collect()}
    assert abs(got["a", "p"] - 0.8) < 0.05 and got["d", "p"] < 0.1
    assert 0.2 < got["a", "rare"] and got["d", "p"] < got["zero", "p"] < 0.8


def test_strength_from_spread(spark):
    same = spark.createDataFrame([(100, 0.5, 0.5)] * 20, "n long, p double, parent double")
    apart = spark.createDataFrame([(100, 0.1, 0.5), (100, 0.9, 0.5)] * 10, "n long, p double, parent double")
    assert Q.strength(same) == Q.MOST_STRENGTH and Q.strength(apart) == Q.LEAST_STRENGTH


def test_edges(spark):
    assert classified(spark, [], []) == []
    rows = [(None, None, None, None), (1, "", "h", None), (1, "", "h", None), (2, "x " * 50000, "h", "p")]
    got = classified(spark, rows, [])
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    got = classified(spark, rows, [(1, 1), (1, 0), (9, 1), (2, None)], F.lit(False))
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)


def test_query_on_held_out_labels(spark, root):
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, root).collect()}
    labels = [r for r in spark.read.parquet(f"{root}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].kept == bool(r.quality) for r in labels) >= 0.85 * len(labels)
