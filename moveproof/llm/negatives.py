"""Hard negatives: rows of another label whose score comes close to a positive's.

Vectors become whole numbers, floor(scale * x); a score is the exact inner
product of two of them. An anchor's positives are its best rows of the same
label, and for each positive the best rows of other labels inside a window of
scores below the positive's are returned.

The index is a GNAT-style multiway hyperplane tree. Its upper part is grown
from at most `sample` rows; every row is then routed to the nearest split point
of each level, and for each split point the least and largest distance to the
rows of every sibling subtree are kept. Leaves are cut into chunks of bounded
size by a hash of the row, so no group of alike rows meets in one task, and a
chunk grows its own small tree where it is searched. A window of scores is an
annulus of distances around the anchor; a subtree is passed over if its ranges
leave no row inside. Leaves are scored exactly, so nothing is lost.

Each search first visits the chunk nearest the anchor, which bounds the scores
worth looking for, then all chunks that the bound leaves. Anchors travel in
blocks, so a task holds one chunk and one block.

Rows with a null label, a null vector, or a null or non-finite component take
no part. A null id counts as the largest; repeated rows count once; rows of
equal id but other label or vector stay apart. Shorter vectors are filled up
with zeros, an empty vector is all zeros. Ties go to the smaller id. Scores
beyond 2**62 count as 2**62. Tables without anchors, positives or negatives give
no rows. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveproof.llm import words as W
from moveproof.llm.frames import LAST_ID, public_id, released, send_code, stored

#: Rows that the upper tree is grown from; all rows are indexed.
SAMPLE = 8192
DEGREE = 16
#: Rows of a chunk, and anchors of a block, if their vectors take 256 octets.
CHUNK = 8192
BLOCK = 4096
LOCAL_DEGREE, LOCAL_LEAF = 8, 256
FAR = 1 << 62
#: Whole numbers below this are exact in doubles, sums included.
EXACT = float(1 << 52)

ROWS = "id long, key long, label long, vec binary, leaf int"
QUERY = "id long, key long, label long, vec binary, lo array<long>, hi array<long>"
FOUND = "id long, key long, slot int, score long, other long, other_key long"


class Split(NamedTuple):
    """Split points, and for each the child: another split, or ~leaf."""

    points: np.ndarray
    child: np.ndarray


class Ranges(NamedTuple):
    """Of one split: near and far [point, child] distances, low and high [child] squared lengths."""

    near: np.ndarray
    far: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2.0 * (rows @ points.T)
    return np.sqrt(np.maximum(squares, 0))


def _split_points(rows: np.ndarray, degree: int) -> np.ndarray:
    """Rows far from each other, each the farthest from those before it; distinct."""
    some = rows[:: max(1, len(rows) // (degree * 32))]
    chosen = [some[0]]
    nearest = _distances(some, some[:1])[:, 0]
    while len(chosen) < degree and nearest.max() > 0:
        chosen.append(some[int(nearest.argmax())])
        nearest = np.minimum(nearest, _distances(some, chosen[-1][None])[:, 0])
    return np.array(chosen)


def grown(rows: np.ndarray, degree: int, most: float, levels: int = 64) -> tuple[list[Split], int]:
    """The splits of a tree whose leaves hold at most `most` of these rows, and the number of leaves.

    A node of equal rows stays a leaf, whatever its size.
    """
    splits: list[Split] = []
    leaves = 0
    todo = [(np.arange(len(rows)), levels, -1, -1)]
    while todo:
        here, left, parent, slot = todo.pop()
        points = _split_points(rows[here], degree) if len(here) > most and left else ()
        if len(points) < 2:
            if parent >= 0:
                splits[parent].child[slot] = ~leaves
            leaves += 1
            continue
        nearest = _distances(rows[here], points).argmin(1)
        splits.append(Split(points, np.zeros(len(points), np.int64)))
        if parent >= 0:
            splits[parent].child[slot] = len(splits) - 1
        at = len(splits) - 1
        todo += [(here[nearest == i], left - 1, at, i) for i in range(len(points))]
    return splits, leaves


def _open(splits: list[Split]) -> list[Ranges]:
    """Ranges of no rows."""
    return [Ranges(np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf))
            for k in (len(s.points) for s in splits)]


def routed(splits: list[Split], rows: np.ndarray, ranges: list[Ranges] | None = None) -> np.ndarray:
    """The leaf of each row; widens `ranges` by the rows."""
    leaf = np.zeros(len(rows), np.int64)
    todo = [(0, np.arange(len(rows)))] if splits else []
    while todo:
        at, here = todo.pop()
        if not len(here):
            continue
        split = splits[at]
        distance = _distances(rows[here], split.points)
        nearest = distance.argmin(1)
        squares = (rows[here]**2).sum(1) if ranges else None
        for i, child in enumerate(split.child):
            mine = nearest == i
            if not mine.any():
                continue
            if ranges:
                near, far, low, high = ranges[at]
                near[:, i] = np.minimum(near[:, i], distance[mine].min(0))
                far[:, i] = np.maximum(far[:, i], distance[mine].max(0))
                low[i] = min(low[i], squares[mine].min())
                high[i] = max(high[i], squares[mine].max())
            if child >= 0:
                todo.append((child, here[mine]))
            else:
                leaf[here[mine]] = ~child
    return leaf


def _reach(split: Split, ranges: Ranges, asked: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """[query, child]: whether a child may hold a row whose score is in one of the query's windows."""
    distance = _distances(asked, split.points)
    squares = (asked**2).sum(1)
    out = np.zeros((len(asked), len(split.child)), bool)
    for c in range(len(split.child)):
        if ranges.low[c] > ranges.high[c]:
            continue
        least = np.maximum(distance - ranges.far[:, c], ranges.near[:, c] - distance).max(1).clip(0)
        most = (distance + ranges.far[:, c]).min(1)
        slack = 1e-9 * (squares + ranges.high[c]) + 1e-6
        inner = squares[:, None] + ranges.low[c] - 2.0 * hi
        outer = squares[:, None] + ranges.high[c] - 2.0 * lo
        out[:, c] = ((inner <= (most**2 + slack)[:, None]) & (outer >= (least**2 - slack)[:, None])
                     & (lo <= hi)).any(1)
    return out


def reached(splits, ranges, asked, lo, hi):
    """Pairs (leaf, indices of the queries that must look into it)."""
    todo = [(0, np.arange(len(asked)))]
    while todo:
        at, here = todo.pop()
        if at < 0 or not splits:
            yield max(~at, 0), here
            continue
        alive = _reach(splits[at], ranges[at], asked[here], lo[here], hi[here])
        todo += [(int(child), here[alive[:, i]]) for i, child in enumerate(splits[at].child)
                 if alive[:, i].any()]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, at most 2**62 either way."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if (a**2).sum(1).max() < EXACT and (b**2).sum(1).max() < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -FAR, FAR).astype(np.int64)


def best_of_chunk(rows, ids, keys, labels, asked, asked_keys, asked_labels, lo, hi, k, same):
    """Arrays query, slot, score, row: per query and window its k best rows of the chunk.

    Rows come in tie order. A window's lower end rises to the k-th best score found.
    """
    splits, _ = grown(rows, LOCAL_DEGREE, LOCAL_LEAF)
    ranges = _open(splits)
    leaf = routed(splits, rows, ranges)
    order = np.argsort(leaf, kind="stable")
    borders = np.searchsorted(leaf[order], np.arange(leaf.max() + 2))
    n, slots = lo.shape
    lo = lo.copy()
    top = np.full((n, slots, k), -FAR - 1, np.int64)
    who = np.full((n, slots, k), len(rows), np.int64)
    for at, here in reached(splits, ranges, asked, lo, hi):
        mine = order[borders[at]:borders[at + 1]]
        found = scores(asked[here], rows[mine])
        fits = (asked_labels[here][:, None] == labels[mine][None]) == same
        if same:
            fits &= asked_keys[here][:, None] != keys[mine][None]
        for w in range(slots):
            ok = fits & (found >= lo[here, w][:, None]) & (found <= hi[here, w][:, None])
            q = np.flatnonzero(ok.any(1))
            if not len(q):
                continue
            value = np.concatenate([top[here[q], w], np.where(ok[q], found[q], -FAR - 1)], 1)
            row = np.concatenate([who[here[q], w], np.broadcast_to(mine, (len(q), len(mine)))], 1)
            pick = np.lexsort((row, -value), axis=-1)[:, :k]
            top[here[q], w] = np.take_along_axis(value, pick, 1)
            who[here[q], w] = np.take_along_axis(row, pick, 1)
            lo[here[q], w] = np.maximum(lo[here[q], w], top[here[q], w, -1])
    q, w, j = np.nonzero(top >= -FAR)
    return q, w, top[q, w, j], who[q, w, j]


def _vectors(column: pa.Array, dtype) -> np.ndarray:
    values, sizes = W.flat(column, dtype)
    return values.reshape(len(sizes), -1).astype(np.float64) if len(sizes) else np.zeros((0, 0))


def _windows(column: pa.Array, fill: int, n: int) -> np.ndarray:
    """A list column as an array; short lists are filled up."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((n, max(int(sizes.max(initial=1)), 1)), fill, np.int64)
    out[np.repeat(np.arange(n), sizes), W.ranges(np.zeros(n, np.int64), sizes)] = column.flatten().to_numpy()
    return out


def _quantized(scale: float, dim: int, dtype):
    def rows(batches):
        for batch in batches:
            sizes = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.zeros((batch.num_rows, dim))
            whole[np.repeat(np.arange(batch.num_rows), sizes), W.ranges(np.zeros(len(sizes), np.int64), sizes)] = (
                np.floor(scale * batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"),
                W.binary(whole.astype(dtype).reshape(-1), np.full(batch.num_rows, dim))], ["id", "label", "vec"])
    return rows


class Index(NamedTuple):
    """Rows with their leaves, the upper tree, chunks of each leaf, and how vectors are stored."""

    rows: DataFrame
    splits: list[Split]
    ranges: list[Ranges]
    chunks: list[int]
    dtype: type


def _prepared(table: DataFrame, scale: float) -> tuple[DataFrame, type, int, int]:
    """Distinct rows id, key, label, vec; the type of a component, the number of them, the rows before."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = table.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    size = usable.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"),
        F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    most, dim = abs(scale) * (size["most"] or 0.0) + 1, max(size["dim"] or 1, 1)
    dtype = next(t for t, bound in ((np.int16, 2.0**15), (np.int32, 2.0**31), (np.float64, np.inf)) if most < bound)
    rows = usable.mapInArrow(released(_quantized(scale, dim, dtype)), "id long, label long, vec binary")
    rows = rows.dropDuplicates(["id", "label", "vec"])
    return rows.withColumn("key", F.xxhash64("id", "label", "vec")), dtype, dim, size["n"]


def build_index(table: DataFrame, scale: float, sample: int, chunk: int) -> Index:
    """`table` has id, label and vec; see the module's docstring."""
    rows, dtype, dim, n = _prepared(table, scale)
    rows = stored(rows.select("id", "key", "label", "vec"), "vectors")
    sample = max(min(sample, (1 << 24) // (8 * dim)), DEGREE)
    drawn = [bytes(r.vec) for r in rows.select("key", "vec").orderBy("key").limit(sample).collect()]
    drawn = np.array([np.frombuffer(v, dtype) for v in drawn], np.float64).reshape(len(drawn), dim)
    most = max(chunk * len(drawn) / max(n, 1), 2 * DEGREE)
    splits, leaves = grown(drawn, DEGREE, most, 2) if len(drawn) else ([], 1)

    def measured(batches):
        found, counts = _open(splits), np.zeros(leaves, np.int64)
        for batch in batches:
            vectors = _vectors(batch.column("vec"), dtype)
            if len(vectors):
                counts += np.bincount(routed(splits, vectors, found), minlength=leaves)
        out = [(-1, 0, i, float(c), 0.0) for i, c in enumerate(counts)]
        for s, r in enumerate(found):
            out += [(s, i, j, float(r.near[i, j]), float(r.far[i, j])) for i, j in np.ndindex(*r.near.shape)]
            out += [(s, -1, j, float(r.low[j]), float(r.high[j])) for j in range(len(r.low))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in zip(*out)], ["split", "point", "child", "least", "most"])

    told = rows.mapInArrow(released(measured), "split long, point long, child long, least double, most double")
    ranges, counts = _open(splits), [0] * leaves
    for r in told.groupBy("split", "point", "child").agg(
            F.min("least").alias("least"), F.max("most").alias("most"), F.sum("least").alias("total")).collect():
        if r.split < 0:
            counts[r.child] = int(r.total)
        else:
            near, far, low, high = ranges[r.split]
            at = (r.point, r.child) if r.point >= 0 else r.child
            (near if r.point >= 0 else low)[at], (far if r.point >= 0 else high)[at] = r.least, r.most
    chunks = [max(1, -(-c // chunk)) for c in counts]
    of = F.element_at(F.array(*[F.lit(c) for c in chunks]), F.col("leaf") + 1)

    def placed(batches):
        for batch in batches:
            leaf = routed(splits, _vectors(batch.column("vec"), dtype))
            yield batch.append_column("leaf", pa.array(leaf, pa.int32()))

    rows = rows.mapInArrow(released(placed), ROWS).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), of).cast("int"))
    return Index(rows, splits, ranges, chunks, dtype)


def search(index: Index, queries: DataFrame, n_queries: int, k: int, same: bool, block: int, home: bool) -> DataFrame:
    """id, key, slot, score, other, other_key: per query and window its k best rows.

    `home` looks only into the first chunk of the leaf nearest the query.
    """
    splits, ranges, dtype = index.splits, index.ranges, index.dtype

    def visits(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            asked = _vectors(batch.column("vec"), dtype)
            if home:
                yield batch.append_column("leaf", pa.array(routed(splits, asked), pa.int32()))
                continue
            lo, hi = _windows(batch.column("lo"), FAR, n), _windows(batch.column("hi"), -FAR, n)
            for leaf, here in reached(splits, ranges, asked, lo, hi):
                if len(here):
                    yield batch.take(pa.array(here)).append_column(
                        "leaf", pa.array(np.full(len(here), leaf), pa.int32()))

    def evaluated(rows: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in zip(
            ("id", "key", "slot", "score", "other", "other_key"),
            (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})
        if not rows.num_rows or not asked.num_rows:
            return empty
        rows = rows.sort_by([("id", "ascending"), ("key", "ascending")])
        ids, keys, labels = (rows.column(c).to_numpy() for c in ("id", "key", "label"))
        n = asked.num_rows
        q, w, score, row = best_of_chunk(
            _vectors(W.column_of(rows, "vec"), dtype), ids, keys, labels,
            _vectors(W.column_of(asked, "vec"), dtype), asked.column("key").to_numpy(),
            asked.column("label").to_numpy(), _windows(W.column_of(asked, "lo"), FAR, n),
            _windows(W.column_of(asked, "hi"), -FAR, n), k, same)
        return pa.table({
            "id": asked.column("id").to_numpy()[q], "key": asked.column("key").to_numpy()[q],
            "slot": w.astype(np.int32), "score": score, "other": ids[row], "other_key": keys[row]})

    blocks = max(1, -(-n_queries // block))
    place = ["leaf", "chunk", "block"]
    of = F.element_at(F.array(*[F.lit(c) for c in index.chunks]), F.col("leaf") + 1)
    asked = queries.mapInArrow(released(visits), QUERY + ", leaf int").withColumn(
        "chunk", F.explode(F.array(F.lit(0)) if home else F.sequence(F.lit(0), of - 1))).withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(blocks)).cast("int"))
    rows = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else (
        index.rows.withColumn("block", F.lit(0)))
    if home:
        rows = rows.filter("chunk = 0")
    found = rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(evaluated, FOUND)
    rank = F.row_number().over(Window.partitionBy("id", "key", "slot").orderBy(
        F.desc("score"), "other", "other_key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Queries whose windows begin at the k-th best score already found."""
    kth = found.filter(F.col("rank") == k).groupBy("id", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    raised = F.transform("lo", lambda x, i: F.greatest(x, F.element_at("kth", i)))
    return queries.join(kth, ["id", "key"], "left").withColumn(
        "lo", F.when(F.col("kth").isNull(), F.col("lo")).otherwise(raised)).drop("kth")


def _floor(amount: Column, by: int) -> Column:
    """floor(amount / by) for whole decimals."""
    return ((amount - F.pmod(amount, F.lit(by).cast("decimal(38,0)"))) / by).cast("long")


def hard_negatives(
    table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    sample: int = SAMPLE, chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is `low` to `high` hundredths of the positive's.
    `is_anchor` is a condition on the whole-number column `id`.
    """
    send_code(table.sparkSession)
    table = table.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vec"))
    index = build_index(table, scale, sample, chunk)
    anchors = index.rows.filter((F.col("id") != LAST_ID) & is_anchor)
    n = anchors.count()
    ends = [F.array(F.lit(e).cast("long")).alias(c) for e, c in ((-FAR, "lo"), (FAR, "hi"))]
    asked = anchors.select("id", "key", "label", "vec", *ends)
    near = search(index, asked, n, positives, True, block, home=True)
    found = stored(search(index, _bounded(asked, near, positives), n, positives, True, block, home=False), "positives")
    share = lambda c: F.col("score").cast("decimal(28,0)") * F.lit(c).cast("decimal(9,0)")
    windows = found.select("id", "key", "rank", (-_floor(-share(low), 100)).alias("lo"),
                           _floor(share(high), 100).alias("hi"))
    windows = windows.groupBy("id", "key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w")).select(
        "id", "key", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    asked = stored(anchors.select("id", "key", "label", "vec").join(windows, ["id", "key"]), "windows")
    near = search(index, asked, n, negatives, False, block, home=True)
    hard = search(index, _bounded(asked, near, negatives), n, negatives, False, block, home=False)
    positive = found.select("id", "key", (F.col("rank") - 1).alias("slot"), public_id("other").alias("positive_id"),
                            F.col("score").alias("positive_score"))
    return hard.join(positive, ["id", "key", "slot"]).select(
        public_id("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        public_id("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
