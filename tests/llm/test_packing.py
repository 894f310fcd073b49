import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moveproof.llm import packing, words as W
from moveproof.llm.queries import QUERIES, tokenizer_path

ODD = ["don't  STOP×now", "a1b22.c!!? ...", "ÉÀ é́x ß ÿ€uro", "<|endoftext|> a|b", "", None, " \n\t", "日本語 テスト。x",
       "it's we'RE 'tis", "x_y-z", " nbsp em", "ŒUVRE ǅ İI Σς ΣΑΣ", "a\x0bb\x1cc", "½ ² ٣ 1٣", "ʰɐ ͏x", "e" * 30000, "🙂🙂 ok"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(pieces, rows, size=4096):
    """Every id in exactly one piece, sequences gapless and bounded, checksums right; returns padding and tokens."""
    encode = tokenizer()
    want = [(i, encode.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_seq[p.sequence_id].append(p)
    assert {i for i, _ in want} == set(of_doc)
    for i, ids in want:
        at = 0
        for p in sorted(of_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            raw = np.array(ids[at:at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(raw)
            at += p.length
        assert at == len(ids)
    padding = 0
    for found in of_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(len(ids) for _, ids in want)


def test_units_encode_like_whole_texts():
    encoder, encode = packing.Encoder(tokenizer_path()), tokenizer()
    rng = random.Random(1)
    alphabet = "aB1.,!' é×÷ñ|<>€́İ\t\n-_"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, sizes = encoder.ids(W.texts_of(pa.array(texts)))
    ends = np.cumsum(sizes)
    for text, end, n in zip(texts, ends, sizes):
        assert ids[end - n:end].tolist() == encode.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_full_table_of_words_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 64)
    encoder, encode = packing.Encoder(tokenizer_path()), tokenizer()
    for k in range(30):
        text = " ".join(f"w{'abcdefgh'[i % 8]}{'xyzuvw'[k % 6]}q" for i in range(k, k + 20))
        assert encoder.ids(W.texts_of(pa.array([text])))[0].tolist() == encode.encode(text, add_special_tokens=False).ids
    text = " ".join("".join(random.Random(i).choices("abcdef", k=7)) for i in range(100))
    assert encoder.ids(W.texts_of(pa.array([text])))[0].tolist() == encode.encode(text, add_special_tokens=False).ids


def brute_cost(places, penalty, whole, size):
    best = {0: 0}
    at = [0, *places]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= size:
                free = n & (n - 1) == 0 and n >= 32 and n < size and whole[j - 1] and (i == 0 or whole[i - 1])
                options.append(best[i] + (0 if free else size - n))
        best[j] = min(options) + penalty[j - 1]
    reach = [j for j in range(len(at) - 1) if at[j] >= at[-1] - size]
    return min(best[j] for j in reach)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    size = 64
    places, at = [], 0
    for _ in range(120):
        at += rng.randint(1, 30)
        places.append(at)
    whole = [rng.random() < 0.3 for _ in places]
    penalty = [0 if w else rng.choice([8, 24]) for w in whole]
    chosen = packing.cuts(np.array(places), np.array(penalty), np.array(whole), size)
    got, before, before_whole = 0, 0, True
    for i in chosen:
        n = places[i] - before
        free = n & (n - 1) == 0 and n >= 32 and n < size and whole[i] and before_whole
        got += (0 if free else size - n) + penalty[i]
        before, before_whole = places[i], whole[i]
    assert got == brute_cost(places, penalty, whole, size)


def test_tail():
    assert packing.tail_lengths(0, 4096) == [] and packing.tail_lengths(4096, 4096) == [4096]
    assert packing.tail_lengths(4090, 4096) == [4090] and packing.tail_lengths(1030, 4096) == [1024, 4, 2]


def test_pieces_of_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("start", "offset")])
    check(packing.pack(docs, tokenizer_path()).collect(), rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokenizer_path()).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1)
    got = sorted((r.sequence_id, r.offset, r.start, r.length) for r in packing.pack(twice, tokenizer_path()).collect())
    assert [g[2:] for g in got] == [(0, 3), (0, 1), (1, 2)]  # six ids: four and two need no padding


def test_query_packs_everything_with_little_padding(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    padding, tokens = check(QUERIES["op9_packing"](spark, root).collect(), rows)
    assert padding < 0.01 * tokens
