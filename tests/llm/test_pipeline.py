"""The pipeline stage by stage, each against brute force on what the stage before it kept."""

import os
import sys

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402
import test_decontaminate as leaks  # noqa: E402
import test_jaccard as near  # noqa: E402
import test_packing as pack  # noqa: E402
import test_substring as repeats  # noqa: E402
from moveproof.llm import decontaminate as D, words as W  # noqa: E402
from moveproof.llm.queries import QUALITY_SQL  # noqa: E402
from moveproof.session import scratch_dir  # noqa: E402


@pytest.fixture(scope="module")
def results(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = scratch_dir(spark, f"test-{name}")
        stage(spark, out[-1], root).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_and_columns(results):
    assert [n for n, _ in P.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    for df in results[1:-1]:
        assert df.dtypes == results[0].dtypes and df.count() > 0


def test_quality(results, root):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({QUALITY_SQL}) WHERE kept").fetchall()}
    assert rows(results[1]) == [r for r in rows(results[0]) if r[0] in kept]


def test_near_duplicates(results):
    before = rows(results[1])
    kept = {doc for doc, _, least in near.brute(before) if doc == least}
    assert rows(results[2]) == [r for r in before if r[0] in kept]


def test_cut(results):
    before, after = rows(results[2]), dict(rows(results[3]))
    want = repeats.brute(before, 50)
    texts = dict(before)
    import hashlib
    for doc, n, gone, digest in want:
        if n and n == gone:
            assert doc not in after
        elif not gone:
            assert after[doc] == texts[doc]
        else:
            assert hashlib.sha256(b" ".join(after[doc].encode().split())).hexdigest() == digest
    assert {r.doc_id: len(r.text) for r in results[3].collect()} == {r.doc_id: r.n_chars for r in results[3].collect()}


def test_decontaminated(results, root, spark):
    before, kept = rows(results[3]), {d for d, _ in rows(results[4])}
    items = spark.read.parquet(f"{root}/benchmark.parquet").collect()
    whole = [d for d, t in before if any(" ".join(i.text.split()) in " ".join(t.split()) for i in items)]
    assert whole and not kept & set(whole)
    def split(texts):
        h, bounds = D.words_and_hashes(W.texts_of(pa.array(texts, pa.string())))
        return [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    own = split([i.text for i in items])
    for (doc, _), words in zip(before, split([t for _, t in before])):
        if doc not in kept:
            assert any(D.best_stretch(i, words) >= D.LIKELY for i in own if D.likely_words(i, words))


def test_packed(results):
    padding, tokens = pack.check(results[5].collect(), rows(results[4]))
    assert padding < 0.01 * tokens


def test_run_equals_the_stages(results, spark, root):
    assert sorted(map(tuple, P.run(spark, root).select("doc_id", "start", "doc_tokens").collect())) and (
        {r.doc_id for r in P.run(spark, root).collect()} == {r.doc_id for r in results[5].collect()})


def test_odd_tables(spark, root):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    long = " ".join(f"w{i}" for i in range(3000))
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, long, None, None, None), (1, long, "en", "s", 5), (1, long, "en", "s", 5),
         (2, "", "en", "s", 0), (3, long + " more", None, "s", None)], schema).withColumn("key", F.lit("x")).withColumn("_id", F.lit(1))
    for docs, want in ((empty, []), (odd, [1])):
        for name, stage in P.STAGES[:-1]:
            path = scratch_dir(spark, f"odd-{name}")
            stage(spark, docs, root).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == list(P.COLUMNS)
        assert [r.doc_id for r in docs.collect()] == want
        assert {r.doc_id for r in P.packed(spark, docs, root).collect()} == set(want)
