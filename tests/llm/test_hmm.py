import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moveproof.llm import hmm
from moveproof.llm.queries import QUERIES

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_base(rows, held):
    tokens = [[*(t or "").encode().translate(LOWER).split(), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total,
             sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws))
            for (i, _), ws in zip(rows, tokens)]


def test_recursions_equal_enumeration():
    rng = np.random.default_rng(1)
    k, c = 3, 4
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    classes, lengths = rng.integers(0, c, 9).astype(np.uint16), np.array([4, 0, 5])
    want, starts, moves, emits = [], np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    at = 0
    for n in lengths:
        part = classes[at:at + n]
        at += n
        paths = {}
        for path in np.ndindex(*[k] * n):
            p = 1.0
            for t, s in enumerate(path):
                p *= (model.start[s] if t == 0 else model.move[path[t - 1], s]) * model.emit[part[t], s]
            paths[path] = p
        total = sum(paths.values())
        want.append(math.log10(total))
        for path, p in paths.items():
            for t, s in enumerate(path):
                emits[s, part[t]] += p / total
                if t == 0:
                    starts[s] += p / total
                else:
                    moves[path[t - 1], s] += p / total
    got = hmm.log10_ratio(model.start, model.move, model.emit, classes, lengths)
    assert np.allclose(got, want)
    start, length = hmm.segments(classes, lengths, 256)
    begin, move, emit = hmm.expected_counts(model, classes, start, length)
    assert np.allclose(begin, starts) and np.allclose(move, moves) and np.allclose(emit, emits)


def test_pieces_cover_every_token_once():
    lengths = np.array([1, 700, 0, 256, 257])
    start, length = hmm.segments(np.zeros(1214, np.uint16), lengths, 256)
    assert sorted(i for s, n in zip(start, length) for i in range(s, s + n)) == list(range(1214))
    assert (np.diff(length) <= 0).all() and length.max() == 256


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_base_equals_brute_force(spark, head):
    rows = [(i, " ".join(f"W{(i * j) % 37}" for j in range(i % 50))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "never seen " * 3000), (103, "É é"), (103, "É é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("ref", "key")])
    held = lambda i: i % 3 == 1 or i == 102
    got = hmm.hmm_scores(docs, (F.col("doc_id") % 3 == 1) | (F.col("doc_id") == 102), rounds=2, head=head).collect()
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for g, w in zip(got, sorted(brute_base(rows, held)), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


def test_probabilities_add_up():
    """Over all known tokens and the unseen one, in every state."""
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 1 << 60, 500).astype(np.uint64), rng.integers(1, 50, 500)
    order = np.argsort(-counts, kind="stable")
    keys, counts = keys[order], counts[order]
    tails = np.bincount((keys & hmm.TAIL).astype(int), counts + 0.5, minlength=1 << hmm.TAIL_BITS)
    words = hmm.Vocabulary(int(counts.sum()), 500, keys, counts, tails)
    model = hmm.Model.first(words.base, 4)
    ratio = model.emit / words.base[:, None]
    known = sum((c + 0.5) / words.space * ratio[k] for c, k in zip(words.counts, words.classes))
    assert (known <= 1 + 1e-9).all()


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.hmm_scores(empty, F.lit(False)).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    got = hmm.hmm_scores(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.base_score) for r in got) == [(2, 0, 0.0), (3, 0, 0.0)]
    assert [r.held_out for r in hmm.hmm_scores(docs, F.col("doc_id") == 1).orderBy("n_tokens").collect()] == [False, True]


def test_query_learns(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op7_lm_scoring"](spark, root).collect()}
    want = brute_base(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    for i, held, n, known, total, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
