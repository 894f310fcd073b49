"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmarks, packing.

Each stage takes a table with the columns of `documents` and returns one, the
last the pieces of packed sequences. Null texts, ids and other columns, repeated
rows and empty tables have the results that the operators state; further columns of the input are dropped.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moveproof.llm import decontaminate, jaccard, line_rules, packing, substring  # noqa: E402
from moveproof.llm.queries import tokenizer_path  # noqa: E402
from moveproof.session import scratch_dir, stored, table  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Documents named by id and hash up to which they are broadcast, 32 octets each; beyond it documents are shuffled.
BROADCAST_NAMES = 400_000


def _named(names: DataFrame) -> DataFrame:
    """_id, _key of documents, stored, and broadcast if they are few."""
    names = stored(names.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "names")
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def _is_named() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents other than those named by doc_id and key, the hash of the text."""
    return docs.join(_named(gone), _is_named(), "left_anti")


def _one_of_repeats(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text; only rows that repeat are shuffled with their texts."""
    names = docs.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    twice = _named(names.filter("n > 1"))
    repeated = docs.join(twice, _is_named(), "left_semi").withColumn("_text", F.xxhash64("text"))
    return docs.join(twice, _is_named(), "left_anti").unionByName(
        repeated.dropDuplicates(["doc_id", "_text"]).drop("_text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are."""
    return line_rules.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of alike documents the one of least id stays, of repeated rows one."""
    docs = docs.select(*COLUMNS)
    return _one_of_repeats(_without(docs, jaccard.jaccard_join(docs).filter("not is_first")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents left without a word by this go.

    Untouched documents keep their text byte for byte.
    """
    cut = substring.dedup_substrings(
        docs, with_text=True, carry=("text", "lang", "source", "n_chars"))
    touched = F.col("n_removed") > 0
    return cut.filter(~touched | (F.col("n_words") > F.col("n_removed"))).select(
        "doc_id", F.when(touched, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(touched, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go."""
    docs = docs.select(*COLUMNS)
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' ids in sequences of at most 4096."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: Several stages cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
