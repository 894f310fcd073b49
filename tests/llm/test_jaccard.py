import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moveproof.llm import graph, jaccard, words as W

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return sorted((doc, len(sets[i]), min(least[root(i)])) for i, (doc, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    common = fresh(9)
    rows = []
    for _ in range(8):
        base = fresh(rng.randint(3, 120))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                words[rng.randrange(len(words))] = rng.choice(["x", "y", "Z"]) + str(rng.randrange(50))
            if rng.random() < 0.3:
                words = words[:rng.randint(len(words) * 4 // 5, len(words))]
            rows.append(" ".join(words))
    rows += [" ".join(common + fresh(rng.randint(1, 4))) for _ in range(15)]
    rows += [" ".join(fresh(rng.randint(1, 40))) for _ in range(20)]
    rows += ["a b", "A  B", "a b c", "", None, " \n", "a b c d e", "x " * 3000, "x " * 2000]
    rng.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(jaccard.jaccard_join(docs)) == brute(rows)


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(49)]  # 45 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:40])), (3, " ".join(base + [f"t{i}" for i in range(9)])),
            (4, " ".join(base[:39])), (5, " ".join(["q"] * 3 + base + ["r"] * 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.jaccard_join(docs)) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, ""), (7, text), (7, text), (7, "other words here"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("id", "node", "n", "comp")])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_join(docs).collect())
    assert got == [("7", 1, "7"), ("7", 46, "7"), ("7", 46, "7"), ("9", 0, "9"), ("None", 0, "None"), ("None", 46, "7")]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r.u: r.v for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_shingle_sets_are_sets():
    texts = ["a b c d e f", "A b C d e f", "a b", "", "x x x x x x x x"]
    shingle, lengths = jaccard.shingle_sets(W.texts_of(pa.array(texts)), 5)
    assert list(lengths) == [2, 2, 1, 0, 1]
    assert np.array_equal(shingle[:2], shingle[2:4])


def test_query_equals_brute_force(spark, root):
    from moveproof.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op5_ngram_jaccard_join"](spark, root)) == brute(rows)
