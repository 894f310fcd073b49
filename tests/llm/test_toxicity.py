import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moveproof.llm import toxicity, words as W
from moveproof.llm.queries import QUERIES


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Nasty,", "vile", "(foul)"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_ftrl_equals_its_definition():
    rng = random.Random(3)
    model, z, n = toxicity.Ftrl(6), [0.0] * 6, [0.0] * 6
    for _ in range(300):
        at, label = sorted(rng.sample(range(6), 3)), rng.randint(0, 1)
        w = [0.0 if abs(z[i]) <= toxicity.L1 else
             -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
             for i in at]
        g = 1 / (1 + np.exp(-np.clip(sum(w), -30, 30))) - label
        for i, wi in zip(at, w):
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * wi
            n[i] += g * g
        model.learn(np.array(at), label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_features_are_words_pairs_and_skips():
    at, of = toxicity.features(W.texts_of(pa.array(["a B, c", "", None, "(b)", "c a"])))
    assert np.bincount(of, minlength=5).tolist() == [6, 0, 0, 1, 3]
    assert at[1] == at[np.flatnonzero(of == 3)[0]]


def test_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("id", F.lit(2))
    known = spark.createDataFrame(labels + [(7000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known, F.col("doc_id") % 3 == 1).collect()
    want = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and len(held) == 200
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_weights_do_not_depend_on_held_out_labels(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for flip in (0, 1):
        known = spark.createDataFrame([(i, y ^ (flip if i % 3 == 1 else 0)) for i, y in labels], "doc_id long, toxic int")
        scores.append({r.doc_id: r.score for r in toxicity.toxicity(docs, known, F.col("doc_id") % 3 == 1).collect()})
    assert scores[0] == scores[1]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, none, F.lit(False)).collect() == []
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, " "), (2, " "), (3, "w " * 50000)], "doc_id long, text string")
    got = toxicity.toxicity(docs, none, F.lit(False)).collect()
    assert [r.score for r in got] == [0.5] * 5 and {r.predicted for r in got} == {0}


def test_query_on_held_out_labels(spark, root):
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, root).collect()}
    labels = spark.read.parquet(f"{root}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert sum(p == t for p, t in held) >= 0.85 * len(held)
