import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moveproof.llm import suffixes, words as W


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(i), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    passages = [text(rng.randint(20, 90)) for _ in range(4)]
    rows = []
    for i in range(40):
        rows.append((i, "".join(rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(1, 40))
                                for _ in range(rng.randint(0, 4)))))
    rows += [(90, "a" * 300), (91, "ab" * 60), (92, None), (93, ""), (94, rows[3][1]), (94, rows[3][1]),
             (None, rows[4][1]), (95, passages[0] + passages[0])]
    return rows


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [4096, 3])
def test_equals_brute_force(spark, hot):
    rows = corpus(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.dedup_bytes(docs, length=24, gram=9, hot=hot)
    assert result(got) == brute(rows, 24)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rows = [(1, "".join(random.Random(3).choice("abcdef ") for _ in range(5000)))]
    rows.append((2, rows[0][1][700:4100]))
    monkeypatch.setattr(W, "SLICE_BYTES", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffixes.dedup_bytes(docs, length=24, gram=9)) == brute(rows, 24)
    import pyarrow as pa
    monkeypatch.setattr(suffixes, "PIECE", 100)
    batch = pa.RecordBatch.from_pylist([{"text": rows[0][1]}])
    parts = list(suffixes._pieces(iter([batch]), 24))
    assert len(parts) > 40
    whole = W.runs_of(suffixes.BYTE_HASH[W.texts_of(batch.column(0)).data], np.array([0, 5000]), 24, 9)
    found = [(s + at + k, a) for _, t, at in parts
             for r in [W.runs_of(suffixes.BYTE_HASH[t.data], t.bounds, 24, 9)]
             for s, n, a in zip(r.start, r.length, r.anchor) for k in range(n)]
    assert found == [(s + k, a) for s, n, a in zip(whole.start, whole.length, whole.anchor) for k in range(n)]


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.sort(rng.choice(3900, 300, replace=False))
    group_start = np.repeat([0, 7, 8, 200], [7, 1, 192, 100])
    group_size = np.repeat([7, 1, 192, 100], [7, 1, 192, 100])
    prefix = W.prefix_hashes(suffixes.BYTE_HASH[data])
    for step, lengths in ((1, np.minimum(60, 4000 - starts)), (-1, np.minimum(60, starts))):
        found = suffixes.Suffixes(data, prefix, starts, lengths, step)
        order = found.sorted(group_start, group_size)
        cut = [bytes(data[s:s + n]) if step > 0 else bytes(data[s - n:s][::-1]) for s, n in zip(starts, lengths)]
        for low, size in ((0, 7), (7, 1), (8, 192), (200, 100)):
            assert [cut[i] for i in order[low:low + size]] == sorted(cut[low:low + size])
        common = found.neighbours(order, group_start)
        for k in range(1, 300):
            x, y = cut[order[k - 1]], cut[order[k]]
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert common[k] == (-1 if k == group_start[k] else same)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup_bytes(empty).collect() == []
    docs = spark.createDataFrame([(1, "x" * 399), (2, "y" * 401)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(0).alias(c) for c in ("id", "key", "marks", "start")])
    got = {r.doc_id: (r.n_removed, r.kept) for r in suffixes.dedup_bytes(docs, with_bytes=True).collect()}
    assert got == {1: (0, b"x" * 399), 2: (401, b"")}


def test_query_equals_brute_force(spark, root):
    from moveproof.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op6_suffix_array_dedup"](spark, root)) == brute(rows, 400)
