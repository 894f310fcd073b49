import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moveproof.llm import decontaminate as D, words as W
from moveproof.llm.queries import QUERIES


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            keep = row[j + 1]
            row[j + 1] = last + 1 if a == b else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x, y = (rng.integers(0, 6, rng.integers(0, 70)).astype(np.uint64) for _ in range(2))
        assert D.common_subsequence(x, y) == lcs(x.tolist(), y.tolist())


def test_passages_overlap_by_half_and_stay_inside_texts():
    texts = W.texts_of(pa.array([" ".join(f"w{i}" for i in range(50)), "", "a", "b " * 17]))
    hashes, bounds = D.words_and_hashes(texts)
    space = np.random.default_rng(1).random((D.FEATURES, 3)).astype(np.float32)
    idf = np.ones(D.FEATURES, np.float32)
    got, starts, of = D.passage_vectors(space, idf, hashes, bounds)
    assert starts.tolist() == [0, 16, 32, 48, 50, 51, 67] and of.tolist() == [0, 0, 0, 0, 2, 3, 3]
    for row, start, text in zip(got, starts, of):
        part = hashes[start:min(start + D.PASSAGE, bounds[text + 1])]
        assert np.allclose(row, space[D.feature_of(part)].sum(0) / np.sqrt(len(part)), rtol=1e-4)


def corpus(seed=2):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"v{rng.randrange(6000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 50))) + ". " + " ".join(word() for _ in range(5)) + ".")
             for i in range(30)]
    rows, want = [], set()
    for d in range(300):
        text = [word() for _ in range(rng.randint(0, 200))]
        kind = rng.random()
        item, leak = rng.choice(items)
        leak = leak.split()
        if kind < 0.15:
            want.add((d, item))
        elif kind < 0.3:  # a paraphrase: some words changed, the answer left
            want.add((d, item))
            leak = [w if k > len(leak) - 6 or rng.random() < 0.8 else word() for k, w in enumerate(leak)]
        elif kind < 0.45:  # a decoy
            leak = leak[:6]
        else:
            leak = []
        at = rng.randint(0, len(text))
        rows.append((d, " ".join(text[:at] + [w.upper() + "," for w in leak] + text[at:])))
    return rows, items, want


def test_leaks_and_paraphrases_are_found_and_decoys_are_not(spark):
    rows, items, want = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cosine", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert not got - want, sorted(got - want)
    assert len(got & want) >= 0.9 * len(want)


def test_answers_decide_on_paraphrases(spark):
    item = [f"q{i}" for i in range(30)]
    changed = [w if i % 3 else f"x{i}" for i, w in enumerate(item)]
    docs = spark.createDataFrame(
        [(1, " ".join(changed + ["blue", "whale"])), (2, " ".join(changed)), (3, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item), "Blue whale")], "item_id long, text string, answer string")
    got = D.contaminated(docs, bench, answer_col="answer").collect()
    assert sorted((r.doc_id, r.item_id, r.has_answer) for r in got) == [(1, 7, True), (3, 7, False)]


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "alone in the world of words that nobody says")], "item_id long, text string")
    assert D.contaminated(none, bench).collect() == []
    docs = spark.createDataFrame([(None, "Alone in the world of words that nobody says"), (4, None), (4, ""), (5, "z " * 40000)],
                                 "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()] == [(None, 3)]
    assert D.contaminated(docs, bench.limit(0)).collect() == []


def test_query_against_brute_force(spark, root):
    """Every item against all words of every document, without the latent search."""
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, root).collect()}
    docs = spark.read.parquet(f"{root}/documents.parquet").collect()
    items = spark.read.parquet(f"{root}/benchmark.parquet").collect()
    split = lambda texts: [h[a:b] for h, bounds in [D.words_and_hashes(W.texts_of(pa.array(texts, pa.string())))]
                           for a, b in zip(bounds[:-1], bounds[1:])]
    words, own = split([r.text for r in docs]), split([r.text for r in items])
    answers = split([D.last_sentence(r.text) for r in items])
    want = set()
    for d, w in zip(docs, words):
        for i, item in enumerate(own):
            if D.likely_words(item, w) and (share := D.best_stretch(item, w)) >= D.LIKELY:
                if share >= D.SURE or D.best_stretch(answers[i], w) >= D.ANSWER:
                    want.add((d.doc_id, items[i].item_id))
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_items_that_leaked_often_or_have_common_words_only_are_found(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"v{rng.randrange(6000)}"
    often = [f"w{i}" for i in range(25)]
    items = [(1, " ".join(often)), (2, " ".join(rng.choice(common) for _ in range(24))), (3, "c7 c3"), (4, "never said so")]
    rows, want = [], set()
    for d in range(400):
        text = [word() for _ in range(rng.randint(40, 120))]
        leak = None
        if d < 150:  # every third of them with some words changed
            leak = (1, [w if d % 3 or i % 6 else word() for i, w in enumerate(often)])
        elif d < 160:
            leak = (2, items[1][1].split())
        if leak:
            want.add((d, leak[0]))
            text[20:20] = leak[1]
        rows.append((d, " ".join(text)))
        want |= {(d, 3) for a, b in zip(text, text[1:]) if (a, b) == ("c7", "c3")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {w for w in want if w[1] != 3} == {g for g in got if g[1] != 3}
    assert {w for w in want if w[1] == 3} <= got


def test_seeds_against_brute_force():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 1, 2, 40, 3, 0, 60)]
    items = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 1, 2, 5, 30)] * 2
    hashes, bounds = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    place, item = D.Seeds(items).found(hashes, bounds)
    want = {(int(bounds[t]) + p, i) for t, text in enumerate(texts) for i, own in enumerate(items)
            for size in [min(D.SEED, len(own))] if size for p in range(len(text) - size + 1)
            for q in range(len(own) - size + 1) if (text[p:p + size] == own[q:q + size]).all()}
    assert set(zip(place.tolist(), item.tolist())) == want and len(place) == len(want)


def test_a_sum_over_passages_is_the_matrix_product():
    rng = np.random.default_rng(6)
    texts = W.texts_of(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 30, n)) for n in (50, 0, 1, 17, 700)]))
    hashes, bounds = D.words_and_hashes(texts)
    idf, basis = (rng.random(D.FEATURES) + 0.1).astype(np.float32), rng.standard_normal((D.FEATURES, 5))
    starts, of = D.blocks_of(bounds)
    a = np.zeros((len(starts), D.FEATURES))
    for row, start, text in zip(a, starts, of):
        feature = D.feature_of(hashes[start:min(start + D.PASSAGE, bounds[text + 1])])
        np.add.at(row, feature, idf[feature])
        row /= np.sqrt((idf[feature] ** 2).sum())
    assert np.allclose(D.seen_by(basis.copy(), idf, [texts])[0], a.T @ (a @ basis), rtol=1e-4, atol=1e-4)


def test_the_cosine_finds_items_however_many_there_are(monkeypatch):
    """Without shared runs of words, so that only the latent spaces can find a changed copy."""
    monkeypatch.setattr(D.Seeds, "found", lambda *_: (np.zeros(0, np.int64),) * 2)
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(20000)}"
    items = [(i, [word() for _ in range(rng.randint(15, 57))]) for i in range(900)]
    texts, want = [], set()
    for d in range(300):
        item, leak = rng.choice(items)
        want.add((d, item))
        texts.append([word() for _ in range(40)] + [w if d % 2 or rng.random() < 0.85 else word() for w in leak]
                     + [word() for _ in range(40)])
    texts = W.texts_of(pa.array([" ".join(t) for t in texts]))
    hashes, bounds = D.words_and_hashes(texts)
    counts = np.bincount(D.feature_of(hashes), minlength=D.FEATURES)
    idf, got = D.inverse_frequency(counts, 300), set()
    seen, _ = D.seen_by(D.random_basis(D.SIZE), idf, [texts])
    for low in range(0, len(items), D.ITEM_BLOCK):
        own = items[low:low + D.ITEM_BLOCK]
        block = W.texts_of(pa.array([" ".join(t) for _, t in own]))
        split = D.words_and_hashes(block)
        each = [split[0][a:b] for a, b in zip(split[1][:-1], split[1][1:])]
        known = D.Items([i for i, _ in own], each, each, [D.scores(seen, 0.0, block, idf)], idf)
        got |= {(text, known.ids[i]) for _, text, i, _ in D.candidates(known, hashes, bounds, D.COSINE)}
    assert len(got & want) >= 0.97 * len(want)
    assert len(got) < 20 * len(want)


def test_items_are_searched_in_passes(spark, monkeypatch):
    rows, items, want = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "ITEM_BLOCK", 4)
    monkeypatch.setattr(D, "ITEM_PASS", 8)
    found = [(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()]
    assert len(found) == len(set(found)) and not set(found) - want
    assert len(set(found)) >= 0.9 * len(want)


def test_the_fit_sees_all_passages_of_a_large_table(spark):
    """2,000 documents: the sum over their passages and its count are those of all, in any split."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    idf = np.random.default_rng(9).random(D.FEATURES) + 0.1
    all_texts = W.texts_of(pa.array(texts))
    want, _ = D.seen_by(D.random_basis(D.SIZE), idf, [all_texts])
    for tasks in (3, 100):
        seen, passages = D.passage_sums(docs, idf, tasks)
        assert np.allclose(seen, want, rtol=1e-4, atol=1e-3)
        assert passages == len(D.blocks_of(D.words_and_hashes(all_texts)[1])[0])


def test_items_keep_their_length_beside_a_large_corpus():
    """Passages that share a few topics have most of the sum, as those of millions of documents would."""
    rng = np.random.default_rng(12)
    word = lambda topic: f"t{topic}x{rng.integers(0, 60)}"
    texts = W.texts_of(pa.array([" ".join(word(d % 70) for _ in range(48)) for d in range(1400)]))
    items = W.texts_of(pa.array([" ".join(f"i{i}x{k}" for k in range(20)) for i in range(D.ITEM_BLOCK)]))
    idf = np.ones(D.FEATURES)
    seen = 1000 * D.seen_by(D.random_basis(D.SIZE), idf, [texts])[0]
    table = D.scores(seen, 1000.0 * 1400 * 3, items, idf)
    near, _, _ = D.passage_vectors(table, idf, *D.words_and_hashes(items))
    assert (np.diag(near[::2]) > 0.8).all()
