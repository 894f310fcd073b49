import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moveproof.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(UPPER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    gap = lambda p, q: (p - q) ** 2 // q
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // whole for t in kept}
        own, all_of = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(-sum(gap(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-gap(own[s][t], all_of[t]), t.encode(), t) for t in kept
                     if counts[lang, s][t] and own[s][t] > all_of[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, r[2], -r[0], i + 1) for i, r in enumerate(ranked)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "The", "the", "Été", "été", "naïve", "x1y", "don't", "𝄞", "b_c", "Ünder", "zz", "long" * 30]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "-", "\x00", ""]) for _ in range(rng.randint(0, 40))),
             rng.choice(["en", "de", None, "", "l\x00g"]), f"s{rng.randint(0, 9) ** 2 % 7}") for i in range(n)]
    rows += [(900, None, "en", None), (901, "", "xx", "alone"), (902, "one two", "xx", "other"), (903, "1 2 3", "xx", "")]
    return rows + rows[:2]


@pytest.mark.parametrize("sizes", [
    {}, dict(block=20, merge=30, side=2), dict(block=7, merge=1, side=1)])
def test_equals_brute_force(spark, sizes):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(D.divergence(docs, top=6, **sizes)) == brute(rows, top=6)


def test_one_source_holds_a_third_and_a_term_stands_everywhere(spark):
    rows = [(i, "common " * 50 + f"own{i % 40} word{i % 11}", "en", "hot" if i % 3 == 0 else f"s{i % 29}") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(40)
    assert found(D.divergence(docs, block=100, merge=200)) == brute(rows)


def test_long_text_and_long_term(spark):
    rows = [(i, "word " * 300_000 + "y" * 200_000, "en", f"s{i % 2}") for i in range(3)] + [(9, "word other", "en", "s0")]
    assert found(D.divergence(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.divergence(empty).collect() == []
    rows = [(1, None, None, None), (2, "a b", None, "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "count", "key", "p", "q", "shard", "first"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert found(D.divergence(docs)) == [("", "", "pair", "t", 0, 1), ("", "t", "pair", "", 0, 1)]


def test_shares_are_exact(spark):
    pairs = [(1, 1), (1, 3), (2, 3), (7 * 10**15, 8 * 10**15 + 1), (1, 9 * 10**15), (123456789, 987654321)]
    df = spark.createDataFrame(pairs, "c long, w long")
    assert [r[0] for r in df.select(D._share("c", "w")).collect()] == [1 + 10**9 * c // w for c, w in pairs]


def test_query_equals_sql(spark, root):
    from compare import difference, duck
    from moveproof.llm.queries import ORACLES, QUERIES

    name = "op11_source_divergence"
    assert difference(spark, duck(root), QUERIES[name], ORACLES[name], root) is None
