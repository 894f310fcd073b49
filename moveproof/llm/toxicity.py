"""Toxicity: logistic regression by FTRL-proximal over hashed n-grams and skip-grams of words.

Features are words, pairs of neighbours and pairs with one word between them
(A-Z lower-cased, marks at the ends of a word left off), present or absent,
hashed into 2**BITS coordinates. Labelled rows are dealt over tasks of `SHARD_ROWS`;
each runs FTRL-proximal with its per-coordinate learning rates and L1 penalty,
and the sparse weights are averaged. The weights, at most one float per
coordinate, are broadcast to score every document.

The fit draws about `label_rows` labelled ids at most, chosen by a hash of the id, and
leaves out the held-out ones among them; they are broadcast, so no text moves but
the rows to learn from. Everything else covers all rows. Labels, ids and other
columns are no inputs of a score. Null text is empty and scores by the bias
alone; a label that is null or names no document is not used; a document with several labels counts
by the largest; without labels every score is 0.5. Repeated rows are scored each, an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveproof.llm import words as W
from moveproof.llm.frames import released, send_code

BITS = 20
#: Rows that one task learns from; so many tasks as the rows make.
SHARD_ROWS = 12_000
EPOCHS = 8
#: Labelled ids that the fit draws from; they are broadcast, a few bytes each.
LABEL_ROWS = 180_000
ALPHA, BETA, L1, L2 = 8.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7
BIAS = 0


def features(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features, with repeats, and the text each is of."""
    texts = W.Texts(W.LOWER[texts.data], texts.bounds)
    found = W.words_of(texts)
    if not len(found.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = W.word_hashes(texts, W.trimmed(texts, found))
    of = np.repeat(np.arange(len(texts.bounds) - 1), np.diff(found.bounds))
    out, owner = [hashes], [of]
    for step, factor in ((1, 3), (2, 5)):
        same = of[step:] == of[:-step]
        out.append(W.mix(hashes[:-step] * np.uint64(factor) + hashes[step:])[same])
        owner.append(of[:-step][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


class Ftrl:
    """Per-coordinate FTRL-proximal of the logistic loss for 0/1 features."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _trained(epochs):
    """Non-zero weights that one task learns from its rows."""
    def rows(batches):
        examples = []
        for batch, texts in W.sliced(batches):
            at, of = features(texts)
            pairs = np.unique(of << BITS | at)
            edges = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
            for i, label in enumerate(batch.column("label").to_pylist()):
                found = (pairs[edges[i]:edges[i + 1]] & ((1 << BITS) - 1)).astype(np.int32)
                examples.append((np.unique(np.append(found, BIAS)), label))
        if examples:
            model = Ftrl(1 << BITS)
            for _ in range(epochs):
                for at, label in examples:
                    model.learn(at, label)
            at = np.flatnonzero(model.n)
            weights = model.weights(at)
            at, weights = at[weights != 0], weights[weights != 0]
            # a coordinate of its own tells how many tasks learned
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1)), pa.array(np.append(weights, 1.0))], ["at", "weight"])
    return rows


def fit(labelled: DataFrame, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all coordinates from rows of id, text, label (0 or 1)."""
    order = F.xxhash64("id", F.lit("fold"))
    shards = max(1, round(labelled.select("id").count() / shard_rows))
    learned = (
        labelled.repartition(shards, order).sortWithinPartitions(order, F.col("id"))
        .select("text", "label").mapInArrow(released(_trained(epochs)), "at long, weight double")
        .groupBy("at").agg(F.sum("weight").alias("weight")).collect()
    )
    sums = {r["at"]: r["weight"] for r in learned}
    out = np.zeros(1 << BITS, np.float32)
    tasks = sums.pop(-1, 1.0)
    for at, weight in sums.items():
        out[at] = weight / tasks
    return out


def scores(weights: np.ndarray, texts: W.Texts) -> np.ndarray:
    at, of = features(texts)
    heavy = weights[at] != 0
    pairs = np.unique(of[heavy] << BITS | at[heavy])
    of, at = pairs >> BITS, pairs & ((1 << BITS) - 1)
    total = np.bincount(of[at != BIAS], weights[at[at != BIAS]], minlength=len(texts.bounds) - 1) + float(weights[BIAS])
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _scored(known, names):
    def rows(batches):
        for batch, texts in W.sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(scores(known.value, texts))], [*names, "score"])
    return rows


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic", label_rows: int = LABEL_ROWS,
) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; rows that are held out teach nothing."""
    send_code(docs.sparkSession)
    found = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > label_rows:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(n)) < label_rows)
    weights = fit(found.filter(~F.col("held_out")).join(F.broadcast(known), "id"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    out = found.mapInArrow(released(_scored(shared, ["id", "held_out"])), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias("doc_id"), "held_out", "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
