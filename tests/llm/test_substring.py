import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moveproof.llm import substring


def brute(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p:p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "é", "longer-than-eight", "x", "y"])
    passages = [[word() for _ in range(rng.randint(5, 60))] for _ in range(4)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 30))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, ""), (1004, " \n"),
             (1005, "a " * 400), (1006, "a " * 200)]
    return rows


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [4096, 3])
def test_equals_brute_force(spark, hot):
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(substring.dedup_substrings(docs, window=12, gram=5, hot=hot)) == brute(rows, 12)


def test_a_full_sketch_loses_nothing(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.dedup_substrings(docs, window=12, gram=5, most_cells=16)
    assert result(got) == brute(rows, 12)


def test_kept_text_cuts_only_removed_words(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, shared), (2, f"own  start\n{shared}\n own\tend ")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring.dedup_substrings(docs, with_text=True).collect()}
    assert got == {1: shared, 2: "own  start\nown\tend "}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    docs = docs.withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("marks", F.lit(2))
    got = substring.dedup_substrings(docs).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == [(5, 0), (5, 0), (None, 50)]


def test_query_equals_brute_force(spark, root):
    from moveproof.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op1_substring_dedup"](spark, root)) == brute(rows, 50)


def test_a_phrase_that_texts_repeat_is_one_row_for_each_text(spark):
    """A text of one phrase over and over has hundreds of runs of one anchor, but few different ones."""
    phrase = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join(phrase * (150 + i % 3) + [f"own{i}"])) for i in range(40)] + [(90, " ".join(phrase * 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (substring.HOT, 60, 3):
        assert result(substring.dedup_substrings(docs, hot=hot)) == brute(rows, 50)

    known = SimpleNamespace(value=SimpleNamespace(
        repeated=lambda anchors: np.ones(len(anchors), bool), hot=lambda anchors: np.zeros(len(anchors), bool)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0]), pa.array([1]), pa.array([rows[0][1]])], ["id", "key", "text"])
    sent = list(substring._candidates(known, 50, 18, False)(iter([batch])))
    assert sum(b.num_rows for b in sent) < 40
    assert sum(len(p.as_py()) // 4 for b in sent for p in b.column("starts")) > 140


def test_the_group_bound_holds_on_repetitive_texts(spark):
    """What the sketch counts is what is sent: with a small bound no group holds more rows than it."""
    phrase = [f"p{i}" for i in range(7)]
    rows = [(i, " ".join(phrase * 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert result(substring.dedup_substrings(docs, hot=50)) == brute(rows, 50)
