"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks.

Documents are cut into passages of `PASSAGE` words that overlap by half. Words
(A-Z lower-cased, marks at the ends left off) are hashed into `FEATURES`
coordinates and weighted by their inverse document frequency over all
documents. A randomised SVD of the passage matrix and the items gives the latent space, one for each
`ITEM_BLOCK` items, as an item keeps its length only where the space has dimensions for it: the
tasks multiply their rows with a random matrix and the result with their rows again. That sum
is the same for all spaces; each adds its own items to it, orthonormalises by the small Gram
matrix and projects. It is fitted on all passages of all documents; an item's row weighs more as there are
more passages, so the corpus does not crowd it out.

Words of many documents weigh `COMMON_WEIGHT` of that, not nothing: a leak makes the item's own
words frequent, and an item may have no others.

A passage is a candidate for an item if the cosine of its tf-idf vector and the
item's latent vector is `COSINE` or more, or if `SEED` consecutive words that start in it are
consecutive in the item too (all words of an item with fewer). The second holds for every
verbatim copy, whatever its words weigh. Candidates are checked in the document's words around the
passage: if the longest common subsequence with some stretch of 1.25 times the
item's length holds `SURE` of the item's words, the document is contaminated; if it holds
`LIKELY` of them, it is a paraphrase if it has the answer too, in the
same way. The answer is a column of the benchmark, or else the item's last sentence.

Null texts have no passages; a null id is reported as null; an item without a
word is never found; repeated rows or items are reported each. No benchmark or
no documents give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.llm import sketch, words as W
from moveproof.llm.frames import identified, public_id, released, send_code

FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
PASSAGE = 32
RANK = 64
SIZE = RANK + 16
#: Bytes of text whose passages one task sums up for the fit; its sum has 21 MB.
FIT_BYTES = 128 << 20
#: Features in more than this share of the documents (and in 20) weigh this part of their idf.
COMMON, COMMON_WEIGHT = 0.02, 0.1
#: Consecutive words in common with an item that make a passage a candidate without the cosine.
SEED = 3
#: Squared weight of a benchmark item's row against a passage's in the fit: at least, and for each passage.
ITEM_WEIGHT, ITEM_SHARE = 900.0, 0.05
COSINE = 0.17
SURE, LIKELY, ANSWER = 0.8, 0.55, 0.8
STRETCH = 1.25
#: Items that share a latent space, fewer than it has dimensions.
ITEM_BLOCK = 40
#: Items that one pass over the documents searches for; a task holds a number per feature for each.
ITEM_PASS = 400


def words_and_hashes(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the range of each text's."""
    texts = W.Texts(W.LOWER[texts.data], texts.bounds)
    found = W.trimmed(texts, W.words_of(texts))
    return W.word_hashes(texts, found), found.bounds


def feature_of(hashes: np.ndarray) -> np.ndarray:
    return sketch.cells_of(hashes, 0, FEATURE_BITS).astype(np.int64)


def _distinct(batches):
    """Each text's distinct features, as values that `feature_of` would give them back for."""
    for _, texts in W.sliced(batches):
        hashes, bounds = words_and_hashes(texts)
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort(hashes ^ W.mix(of.astype(np.uint64)))
        mixed = (hashes ^ W.mix(of.astype(np.uint64)))[order]
        new = np.ones(len(order), bool)
        new[1:] = np.diff(mixed) != 0
        yield hashes[order][new]


def inverse_frequency(counts: np.ndarray, total: int) -> np.ndarray:
    return np.log1p(total / (counts + 1)) * np.where(counts > max(20, COMMON * total), COMMON_WEIGHT, 1.0)


def blocks_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of half passages, each inside one text, and the text each is of."""
    half = PASSAGE // 2
    n = -(-np.diff(bounds) // half)
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(bounds[:-1], n) + half * W.ranges(np.zeros(len(n), np.int64), n), of


def sums_of(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over consecutive short runs of `rows` that begin at `starts`.

    The runs' first rows are added at once, then their second ones, and so on.
    """
    length = np.diff(starts, append=len(rows))
    order = np.argsort(-length, kind="stable")
    first, longer = starts[order], np.searchsorted(-length[order], -np.arange(1, length.max(initial=0)), "left")
    total = np.take(table, rows[first], axis=0)
    held = np.empty_like(total)
    for k, n in enumerate(longer.tolist(), 1):
        total[:n] += np.take(table, rows[first[:n] + k], axis=0, out=held[:n], mode="clip")
    out = held
    out[order] = total
    return out


class Passages:
    """A slice's passages: their first words, texts, and whole tf-idf lengths.

    The length counts the words outside the latent space too, so a passage that
    shares one word with an item is not taken for it.
    """

    def __init__(self, idf: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        self.starts, self.of = blocks_of(bounds)
        self.features = feature_of(hashes)
        self.same = np.flatnonzero(self.of[1:] == self.of[:-1])
        weight = idf[self.features]
        squares = np.add.reduceat(weight * weight, self.starts) if len(self.starts) else np.zeros(0, np.float32)
        self.length = np.sqrt(np.maximum(self._whole(squares), 1e-12))

    def _whole(self, sums: np.ndarray) -> np.ndarray:
        """Sums over half passages to those over passages."""
        sums[self.same] += sums[self.same + 1]
        return sums

    def vectors(self, space: np.ndarray) -> np.ndarray:
        return self._whole(sums_of(space, self.features, self.starts)) / self.length[:, None]


def passage_vectors(space: np.ndarray, idf: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
    """Each passage's latent vector over its whole tf-idf length; its first word; and its text."""
    found = Passages(idf, hashes, bounds)
    return found.vectors(space), found.starts, found.of


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _rows(texts: W.Texts, idf: np.ndarray):
    """Unit tf-idf rows of whole texts as (row of each entry, feature, value, number of rows)."""
    hashes, bounds = words_and_hashes(texts)
    n = len(bounds) - 1
    row, feature = np.repeat(np.arange(n), np.diff(bounds)), feature_of(hashes)
    key, count = np.unique(row << FEATURE_BITS | feature, return_counts=True)
    row, feature = key >> FEATURE_BITS, key & (FEATURES - 1)
    value = (count * idf[feature]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    return row, feature, (value / np.maximum(norm[row], 1e-12)).astype(np.float32), n


def random_basis(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, size), dtype=np.float32)


def _times(row, feature, value, n, matrix):
    """The sparse rows times a dense matrix; rows are ascending."""
    out = np.zeros((n, matrix.shape[1]), np.float32)
    if len(row):
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[edge]] = np.add.reduceat(matrix[feature] * value[:, None], edge, axis=0)
    return out


def _by_key(table: np.ndarray, rows: np.ndarray, keys: np.ndarray):
    """The distinct keys and, for each, the sum of the table's rows; keys are ascending."""
    while True:
        edge = np.flatnonzero(np.diff(keys, prepend=-1))
        n = -(-np.diff(edge, append=len(keys)) // PASSAGE)
        starts = np.repeat(edge, n) + PASSAGE * W.ranges(np.zeros(len(n), np.int64), n)
        table, keys = sums_of(table, rows, starts), keys[starts]
        if len(keys) == len(edge):
            return keys, table
        rows = np.arange(len(keys))


def seen_by(basis: np.ndarray, idf: np.ndarray, slices) -> tuple[np.ndarray, int]:
    """Sum of a (a' basis) over the rows a of the passage matrix, features by columns of the basis; number of rows.

    The basis is used up.
    """
    idf = idf.astype(np.float32)
    basis *= idf[:, None]  # in place, as it is large
    total, passages = np.zeros(basis.shape), 0
    for texts in slices:
        found = Passages(idf, *words_and_hashes(texts))
        passages += len(found.starts)
        if len(found.starts):
            own = found.vectors(basis) / found.length[:, None]
            both = own.copy()
            both[found.same + 1] += own[found.same]
            half = np.repeat(np.arange(len(found.starts)), np.diff(found.starts, append=len(found.features)))
            order = np.argsort(found.features.astype(np.uint16), kind="stable")
            feature, sums = _by_key(both, half[order], found.features[order])
            total[feature] += sums
    total *= idf[:, None]
    return total, passages


def _seen(known):
    """Parts 0 to 15 of the rows of `seen_by`, and as part 16 the number of passages."""
    def rows(batches):
        total, passages = seen_by(random_basis(SIZE), known.value, (texts for _, texts in W.sliced(batches)))
        for i, part in enumerate([*np.split(total, 16), np.array([passages])]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([part.astype("<f4").tobytes()])], ["part", "sums"])
    return rows


def _added(dtype):
    def merge(table):
        total = sum(np.frombuffer(s.as_buffer(), dtype).astype(np.float64) for s in table.column("sums"))
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.astype(dtype).tobytes()])})
    return merge


def _collected(frame: DataFrame, dtype, tasks: int) -> np.ndarray:
    sums = sketch.folded(frame, "part", _added(dtype), "part int, sums binary", tasks=tasks).collect()
    return np.concatenate([np.frombuffer(r["sums"], dtype) for r in sorted(sums)]) if sums else np.zeros(0, dtype)


def passage_sums(found: DataFrame, idf: np.ndarray, tasks: int) -> tuple[np.ndarray, float]:
    """What all latent spaces need of the passages, features by SIZE, and how many there are."""
    known = found.sparkSession.sparkContext.broadcast(idf)
    sums = found.select("text").coalesce(tasks).mapInArrow(released(_seen(known)), "part int, sums binary")
    seen = _collected(sums, "<f4", tasks)
    if not len(seen):
        return np.zeros((FEATURES, SIZE), np.float32), 0.0
    return seen[:-1].reshape(FEATURES, SIZE), float(seen[-1])


def latent_space(seen: np.ndarray, passages: float, items: W.Texts, idf: np.ndarray) -> np.ndarray:
    """idf-weighted right singular vectors of the passages and the items: features by RANK."""
    heavy = np.sqrt(max(ITEM_WEIGHT, ITEM_SHARE * passages))
    basis = random_basis(SIZE)
    row, feature, value, n = _rows(items, idf)
    own = _times(row, feature, value, n, basis).astype(np.float64) * heavy
    parts = [slice(low, low + FEATURES // 16) for low in range(0, FEATURES, FEATURES // 16)]
    gram = sum((basis[part].T.astype(np.float64) @ seen[part] for part in parts), own.T @ own)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * max(values[-1], 1e-300)
    inverse = vectors[:, keep] / np.sqrt(values[keep])
    b = np.empty((FEATURES, inverse.shape[1]))
    for part in parts:
        b[part] = seen[part] @ inverse
    np.add.at(b, feature, (own @ inverse)[row] * (value * heavy)[:, None])
    strength, left = np.linalg.eigh(b.T @ b)
    strength, left = strength[::-1][:RANK], left[:, ::-1][:, :RANK]
    space = b @ (left / np.sqrt(np.maximum(strength, 1e-12)))
    space *= idf[:, None]
    return space.astype(np.float32)


def scores(seen: np.ndarray, passages: float, items: W.Texts, idf: np.ndarray) -> np.ndarray:
    """What a word adds to its passage's product with each item's latent unit vector: features by items."""
    space = latent_space(seen, passages, items, idf)
    hashes, bounds = words_and_hashes(items)
    sums = [space[feature_of(hashes[a:b])].sum(0) for a, b in zip(bounds[:-1], bounds[1:])]
    return space @ unit(np.array(sums)).astype(np.float32).T


def common_subsequence(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine operation per word of the passage."""
    where: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in passage.tolist():
        found = row & where.get(word, 0)
        row = ((row + found) | (row - found)) & full
    return len(item) - row.bit_count()


def best_stretch(item: np.ndarray, words: np.ndarray) -> float:
    """Largest share of the item that is a subsequence of some stretch of STRETCH times its length."""
    n, size = len(item), int(np.ceil(STRETCH * len(item)))
    if n == 0:
        return 0.0
    step = max(1, n // 8)
    best = 0
    for at in range(0, max(1, len(words) - size + step), step):
        best = max(best, common_subsequence(item, words[at:at + size]))
        if best == n:
            break
    return best / n


def likely_words(item: np.ndarray, words: np.ndarray) -> bool:
    """Are enough of the item's words there at all for a subsequence of the likely length."""
    there = set(words.tolist())
    return sum(w in there for w in item.tolist()) >= LIKELY * len(item)


class Seeds:
    """The items' runs of SEED words, sorted by hash, with the items of each; shorter items are one run."""

    BITS = 20

    def __init__(self, hashes: list[np.ndarray]):
        self.runs = []
        for size in range(1, SEED + 1):
            own = [i for i, h in enumerate(hashes) if min(len(h), SEED) == size]
            if own:
                grams = [np.unique(W.window_hashes(hashes[i], size)) for i in own]
                items = np.repeat(np.array(own), [len(g) for g in grams])
                flat = np.concatenate(grams)
                order = np.argsort(flat, kind="stable")
                there = np.zeros(1 << self.BITS, bool)
                there[flat >> np.uint64(64 - self.BITS)] = True
                self.runs.append((size, flat[order], items[order], there))

    def found(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of runs inside one text that items have, and the item, for each such pair."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, known, of, there in self.runs:
            grams = W.window_hashes(hashes, size)
            at = np.flatnonzero(there[grams >> np.uint64(64 - self.BITS)])
            low, high = (np.searchsorted(known, grams[at], side) for side in ("left", "right"))
            inside = at + size <= bounds[np.searchsorted(bounds, at, "right")]
            n = np.where(inside, high - low, 0)
            places.append(np.repeat(at, n))
            items.append(of[W.ranges(low, n)])
        return np.concatenate(places), np.concatenate(items)


class Items:
    """What a task needs of some of the benchmark's items: `scores` has a table for each ITEM_BLOCK of them."""

    def __init__(self, ids, hashes, answers, scores, idf):
        self.ids, self.hashes, self.answers, self.scores = ids, hashes, answers, scores
        self.idf = idf.astype(np.float32)
        self.seeds = Seeds(hashes)


def candidates(items: Items, hashes, bounds, cosine: float):
    """(passage start, text, item, cosine) of passages whose cosine reaches the bound or that have a seed.

    The tables are in single precision.
    """
    passages = Passages(items.idf, hashes, bounds)
    starts, of = passages.starts, passages.of
    at, seeded = items.seeds.found(hashes, bounds)
    at = np.searchsorted(starts, at, "right") - 1
    low = 0
    for table in items.scores:
        near = passages.vectors(table)
        chosen = near >= cosine
        own = (seeded >= low) & (seeded < low + near.shape[1])
        chosen[at[own], seeded[own] - low] = True
        passage, item = np.nonzero(chosen)
        for p, i in zip(passage.tolist(), item.tolist()):
            yield int(starts[p]), int(of[p]), low + i, float(near[p, i])
        low += near.shape[1]


def _searched(known, tables, cosine):
    def rows(batches):
        items = known.value
        items.scores = [np.asarray(table.value, np.float32) for table in tables]  # once a task, as it is slow
        for batch, texts in W.sliced(batches):
            hashes, bounds = words_and_hashes(texts)
            found: dict[tuple[int, int], tuple] = {}
            for start, text, item, near in candidates(items, hashes, bounds, cosine):
                own = items.hashes[item]
                low = max(bounds[text], start - len(own))
                around = hashes[low:min(bounds[text + 1], start + PASSAGE + len(own))]
                if not likely_words(own, around):
                    continue
                share = best_stretch(own, around)
                if share < LIKELY:
                    continue
                answer = best_stretch(items.answers[item], around) >= ANSWER
                now = (share >= SURE or answer, share, near, answer)
                found[text, item] = max(found.get((text, item), now), now)
            if found:
                owner = pa.array([t for t, _ in found])
                values = list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(owner), batch.column("key").take(owner),
                     pa.array([items.ids[i] for _, i in found], pa.int64()),
                     *(pa.array([v[k] for v in values], t) for k, t in (
                         (2, pa.float64()), (1, pa.float64()), (3, pa.bool_()), (0, pa.bool_())))],
                    ["id", "key", "item_id", "cosine", "common", "has_answer", "contaminated"])
    return rows


def last_sentence(text: str) -> str:
    parts = [p for p in text.replace("!", ".").replace("?", ".").replace("\n", " ").split(".") if p.strip()]
    return parts[-1] if parts else ""


def contaminated(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None,
) -> DataFrame:
    """doc_id, key, item_id, cosine, common, has_answer for each contaminated pair.

    The benchmark is the stated query set: its texts and vectors are broadcast.
    """
    send_code(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    found = identified(docs, id_col, text_col)
    answer = F.col(f"`{answer_col}`").cast("string") if answer_col else F.lit(None).cast("string")
    asked = benchmark.select(
        F.col(f"`{item_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"),
        answer.alias("a")).orderBy("i", "t").collect()
    schema = ("id long, key long, item_id long, cosine double, common double, has_answer boolean, "
              "contaminated boolean")
    split = [[h[a:b] for a, b in zip(bounds[:-1], bounds[1:])] for h, bounds in (
        words_and_hashes(W.texts_of(pa.array(column, pa.string()))) for column in (
            [r["t"] for r in asked], [last_sentence(r["t"]) if r["a"] is None else r["a"] for r in asked]))]
    total, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    counts = sketch.frequencies(found.select("text"), _distinct, FEATURES).astype(np.float64)
    idf = inverse_frequency(counts, total)
    tasks = max(context.defaultParallelism, math.ceil((size or 0) / FIT_BYTES))
    seen = passage_sums(found, idf, tasks)
    blocks = [W.texts_of(pa.array([r["t"] for r in asked[low:low + ITEM_BLOCK]], pa.string()))
              for low in range(0, len(asked), ITEM_BLOCK)]
    passes = []
    for low in range(0, max(1, len(asked)), ITEM_PASS):
        own, each = slice(low, low + ITEM_PASS), slice(low // ITEM_BLOCK, (low + ITEM_PASS) // ITEM_BLOCK)
        known = context.broadcast(Items(
            [r["i"] for r in asked[own]], split[0][own], split[1][own], [], idf))
        # each executor keeps a copy on disk; half precision moves a cosine by less than 0.001
        tables = [context.broadcast(scores(*seen, texts, idf).astype(np.float16)) for texts in blocks[each]]
        passes.append(found.mapInArrow(released(_searched(known, tables, cosine)), schema))
    pairs = reduce(DataFrame.union, passes).filter("contaminated")
    return pairs.select(public_id().alias("doc_id"), "key", "item_id", "cosine", "common", "has_answer")
