"""Quality classifier: document evidence and site posteriors, shrunk level by level.

Evidence is a naive Bayes log ratio over binned measures of the text (symbols,
capitals, repeated neighbours, distinct words, word length, sentence ends,
bare marks, length), its tables counted over all labelled rows that are not
held out, and calibrated by a logistic fit of slope and intercept. Each
document then counts for its site as its label or, without one, as its
calibrated probability. Sites form a hierarchy, host and path within a host: a
level's posterior mean is (sum + m * parent) / (count + m), where the strength m
of the parent is estimated from the spread between the sites of that level
(empirical Bayes, method of moments). A sparse site thus falls back to its host
and a sparse host to the global mean. The score replaces the global prior in the
document's log odds by its path's posterior.

All sums are grouped aggregations; the driver sees tables of features by bins
and a few totals. Null text is measured as empty; null host or path is a site of its
own; a label that is null or names no document is not used; without labels
the evidence is 0 and the score 0.5. Repeated rows are scored each; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveproof.llm import words as W
from moveproof.llm.frames import released, send_code, stored

BINS = 16
FEATURES = ("symbols", "capitals", "repeats", "distinct", "word_length", "sentence_ends", "bare_marks", "length")
SMOOTH = 1.0
STEPS = 12
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
KEEP = 0.5
FACTS = "id long, host string, path string, held_out boolean, bins array<int>"

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>!@^~_=+{}[]\\/")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[0x41:0x5B] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?")] = True


def measures(texts: W.Texts) -> np.ndarray:
    """Texts by features: bins of the measures."""
    found = W.words_of(texts)
    n = np.diff(found.bounds)
    of = np.repeat(np.arange(len(n)), n)
    size = np.maximum(np.diff(texts.bounds), 1)
    byte_of = np.repeat(np.arange(len(n)), np.diff(texts.bounds))

    def per_text(flags, owner):
        return np.bincount(owner[flags], minlength=len(n))

    words = np.maximum(n, 1)
    hashes = W.span_hashes(W.LOWER[texts.data], found.starts, found.ends)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    mixed = hashes ^ W.mix(of.astype(np.uint64))
    _, first = np.unique(mixed, return_index=True)
    length = found.ends - found.starts
    core = W.trimmed(texts, found)
    if len(hashes):
        bare = W.MARKS[texts.data[core.starts]] & (core.ends - core.starts == 1)
        ends = SENTENCE_END[texts.data[found.ends - 1]]
    else:
        bare = ends = np.zeros(0, bool)
    shares = [
        per_text(SYMBOL[texts.data], byte_of) / size, per_text(CAPITAL[texts.data], byte_of) / size,
        per_text(same, of) / words, np.bincount(of[first], minlength=len(n)) / words,
        np.minimum(np.bincount(of, length, minlength=len(n)) / words / 24, 1),
        per_text(ends, of) / words, per_text(bare, of) / words,
    ]
    columns = [np.minimum((np.sqrt(s) * BINS).astype(int), BINS - 1) for s in shares]
    columns.append(np.minimum(np.log2(n + 1).astype(int), BINS - 1))
    return np.stack(columns, 1).astype(np.int32)


def _facts(batches):
    for batch, texts in W.sliced(batches):
        bins = measures(texts)
        offsets = pa.array(np.arange(0, bins.size + 1, len(FEATURES), dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "host", "path", "held_out")),
             pa.ListArray.from_arrays(offsets, pa.array(bins.reshape(-1)))],
            ["id", "host", "path", "held_out", "bins"])


def bin_weights(labelled: DataFrame) -> list[list[float]]:
    """log P(bin | 1) / P(bin | 0) for each feature; zero where a class has no rows."""
    counts = np.zeros((2, len(FEATURES), BINS))
    cells = labelled.select("label", F.posexplode("bins").alias("feature", "bin"))
    for row in cells.groupBy("label", "feature", "bin").count().collect():
        counts[row["label"], row["feature"], row["bin"]] = row["count"]
    if not (counts.sum((1, 2)) > 0).all():
        return np.zeros((len(FEATURES), BINS)).tolist()
    share = (counts + SMOOTH) / (counts + SMOOTH).sum(2, keepdims=True)
    return np.log(share[1] / share[0]).tolist()


def evidence(bins: Column, weights: list[list[float]]) -> Column:
    parts = [F.element_at(F.array(*map(F.lit, w)), F.get(bins, i) + 1) for i, w in enumerate(weights)]
    return sum(parts[1:], parts[0])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibrated(labelled: DataFrame) -> tuple[float, float]:
    """Intercept and slope of a logistic fit of the label on `evidence`, by Newton steps on grouped sums.

    Evidence is a sum of bin weights, so rows are first counted per rounded value.
    """
    table = labelled.groupBy(F.round("evidence", 2).alias("x"), "label").count().toPandas()
    if table["label"].nunique() < 2:
        return 0.0, 0.0
    x, y, n = (table[c].to_numpy(float) for c in ("x", "label", "count"))
    a, b = 0.0, 0.5
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([np.sum(n * (y - p)), np.sum(n * (y - p) * x) - b])
        hessian = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(a), float(b)


def strength(sites: DataFrame) -> float:
    """The prior's weight in documents, from the spread between sites (n, p, parent).

    With variance t of the sites' true means around their parent q, the prior
    Beta(m q, m (1 - q)) has t = q (1 - q) / (m + 1).
    """
    q = F.col("parent") * (1 - F.col("parent"))
    row = sites.agg(
        F.sum(F.col("n") * (F.col("p") - F.col("parent")) ** 2).alias("between"), F.sum(q).alias("noise"),
        F.sum(F.col("n") * q).alias("scale"), F.sum("n").alias("n")).first()
    if not row["n"] or not row["scale"]:
        return MOST_STRENGTH
    excess = (row["between"] - row["noise"]) / row["scale"]  # t / (q (1 - q))
    return min(max(1 / excess - 1, LEAST_STRENGTH), MOST_STRENGTH) if excess > 0 else MOST_STRENGTH


def site_posteriors(counted: DataFrame) -> DataFrame:
    """host, path, posterior from rows of host, path, credit."""
    paths = stored(counted.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("credit").alias("s")), "sites")
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = min(max(total if total is not None else 0.5, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn(
        "p", F.col("s") / F.col("n")).withColumn("parent", F.lit(mean))
    m = strength(hosts)
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("s") + m * mean) / (F.col("n") + m)).alias("parent"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).withColumn("p", F.col("s") / F.col("n"))
    m = strength(sites)
    return stored(sites.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"),
        ((F.col("s") + m * F.col("parent")) / (F.col("n") + m)).alias("posterior"),
        F.lit(mean).alias("prior")), "posteriors")


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, keep: float = KEEP, id_col: str = "doc_id",
    text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality",
) -> DataFrame:
    """doc_id, host, path, held_out, evidence, site_posterior, score, kept for each document.

    Labels of rows that are held out are not looked at.
    """
    send_code(docs.sparkSession)
    found = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"))
    facts = stored(found.mapInArrow(released(_facts), FACTS), "measures")
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    trained = facts.filter(~F.col("held_out")).join(known, "id")
    weights = bin_weights(trained)
    scored = facts.withColumn("evidence", evidence(F.col("bins"), weights))
    a, b = calibrated(trained.withColumn("evidence", evidence(F.col("bins"), weights)))
    own = sigmoid(F.lit(a) + F.lit(b) * F.col("evidence"))
    teach = F.when(~F.col("held_out"), F.col("label").cast("double"))
    sites = site_posteriors(scored.join(known, "id", "left").select(
        "host", "path", F.coalesce(teach, own).alias("credit")))
    at_site = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    odds = lambda p: F.log(p / (1 - p))
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("posterior")))
    score = sigmoid(F.lit(a) + F.lit(b) * F.col("evidence") + odds(clipped) - odds(F.col("prior")))
    return scored.join(sites, at_site).select(
        F.col("id").alias("doc_id"), "host", "path", "held_out", "evidence",
        F.col("posterior").alias("site_posterior"), score.alias("score"), (score >= keep).alias("kept"))
