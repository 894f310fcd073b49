"""N-gram Jaccard join: documents whose word-shingle sets are alike, and their components.

A set holds the hashes of the distinct `size`-word shingles of a text (A-Z
lower-cased; fewer words: the whole sequence as one; no words: an empty set,
linked with nothing). Two sets link when intersection / union >= `percent` / 100.

Shingles are ordered rare first, by the counts of a one-row sketch and then by
hash; any total order gives right results. A set sends the first tokens of its
order, enough for every set it can link with to share one (the shorter of two
sets needs fewer). Per token, a length and a positional filter drop pairs that
cannot reach the overlap. The suffix filter compares the sets by parity sketches,
a bit per class of tokens that tells whether the set holds an odd number of
them: two sketches differ in at most as many bits as the sets in tokens. Each
pair left is verified once on the full sets.

Equal sets are one node. Within a token's list each node is first paired with
a few pivots only, and of these pairs each node verifies the most promising;
what this links becomes one component. A second round pairs all nodes of
different components that share a token and pass the filters, so no link
between components is lost, and groups of near copies are not expanded into
all their pairs.

Null text counts as empty, a null id as the largest (its component_id is null
if no other id is in the component). Rows repeating an id are documents of
their own. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.llm import sketch, words as W
from moveproof.llm.frames import identified, partitions, public_id, released, send_code, stored, text_bytes
from moveproof.llm.graph import components

SIZE = 5
PERCENT = 80
ORDER_CELLS = 1 << 20
MEMBER_CELLS = 1 << 27
#: Bits of a set's parity sketch.
PARITY_BITS = 512
PIVOTS = 4
#: Pairs with pivots that each node verifies in the first round.
TRIES = 3
#: Pairs that a task holds before it sends them on.
PAIR_BLOCK = 1 << 18

FACTS = "id long, key long, name long, node long, n long, parity binary"
POSTING = "token long, node long, n int, place int"


def shingle_sets(texts: W.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, concatenated, and each set's size."""
    texts = W.Texts(W.LOWER[texts.data], texts.bounds)
    found = W.words_of(texts)
    hashes = W.word_hashes(texts, found)
    n_words = np.diff(found.bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    counts = np.maximum(n_words - size + 1, 0)
    all_windows = W.window_hashes(hashes, size)
    shingles = all_windows[W.ranges(found.bounds[:-1], counts)]
    of = np.repeat(np.arange(len(counts)), counts)
    if len(short):
        whole = [W.window_hashes(hashes[found.bounds[i]:found.bounds[i + 1]], n_words[i])[0] ^ np.uint64(n_words[i])
                 for i in short]
        shingles, of = np.append(shingles, np.array(whole, np.uint64)), np.append(of, short)
    order = np.lexsort((shingles, of))
    shingles, of = shingles[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(shingles) != 0) | (np.diff(of) != 0)
    return shingles[new], np.bincount(of[new], minlength=len(counts))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def nodes_of(shingles: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A digest of each set."""
    return W.mix(_sums(W.mix(shingles), lengths) ^ W.mix(lengths.astype(np.uint64)))


def _names(batch: pa.RecordBatch) -> np.ndarray:
    """One number for the id and text of each row, by which rows are looked up."""
    return W.mix(batch.column("id").to_numpy().view(np.uint64)) ^ batch.column("key").to_numpy().view(np.uint64)


def _facts(size):
    def rows(batches):
        for batch, texts in W.sliced(batches):
            shingles, lengths = shingle_sets(texts, size)
            nodes = nodes_of(shingles, lengths)
            cell = np.repeat(np.arange(len(lengths)), lengths) * PARITY_BITS + (
                shingles >> np.uint64(65 - PARITY_BITS.bit_length())).astype(np.int64)
            odd = np.bincount(cell, minlength=len(lengths) * PARITY_BITS) & 1
            parity = np.packbits(odd.astype(bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(_names(batch).view(np.int64)),
                 pa.array(nodes.view(np.int64)),
                 pa.array(lengths.astype(np.int64)),
                 W.binary(parity, np.full(len(lengths), PARITY_BITS // 8))],
                ["id", "key", "name", "node", "n", "parity"])
    return rows


def _shingles(size):
    def hashes_of(batches):
        for _, texts in W.sliced(batches):
            yield shingle_sets(texts, size)[0]
    return hashes_of


def least_overlap(x, y, percent):
    """Intersection that sets of x and y elements need: percent / (100 + percent) of their sum."""
    return -(-percent * (x + y) // (100 + percent))


def _prefixes(levels, size, percent):
    """Postings of each set's first tokens in the global order; a task sends equal sets once."""
    def rows(batches):
        bits = len(levels.value).bit_length() - 1
        seen = set()
        for _, texts in W.sliced(batches):
            shingles, lengths = shingle_sets(texts, size)
            nodes = nodes_of(shingles, lengths)
            ends = np.cumsum(lengths)
            of = np.repeat(np.arange(len(lengths)), lengths)
            level = levels.value[sketch.cells_of(shingles, 0, bits).astype(np.int64)]
            order = np.lexsort((shingles, level, of))
            place = np.arange(len(of)) - np.repeat(ends - lengths, lengths)
            wanted = lengths + percent * -lengths // 100 + 1
            fresh = np.zeros(len(lengths), bool)
            for i, node in enumerate(nodes.tolist()):
                if lengths[i] and node not in seen:
                    seen.add(node)
                    fresh[i] = True
            keep = fresh[of] & (place < wanted[of])
            picked = of[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles[order][keep].view(np.int64)), pa.array(nodes[picked].view(np.int64)),
                 pa.array(lengths[picked].astype(np.int32)), pa.array(place[keep].astype(np.int32))],
                ["token", "node", "n", "place"])
    return rows


def can_link(nx, ny, px, py, percent):
    """Length and positional filter, and the prefix that the shorter set needs; arrays of pairs."""
    short, long = np.minimum(nx, ny), np.maximum(nx, ny)
    need = least_overlap(nx, ny, percent)
    place = np.where(nx <= ny, px, py)
    index = short - least_overlap(short, short, percent) + 1
    return (100 * short >= percent * long) & (1 + np.minimum(nx - px, ny - py) - 1 >= need) & (place < index)


def differ_little(px, py, nx, ny, percent):
    """Suffix filter: parity sketches that differ in no more bits than linked sets may in tokens."""
    apart = np.bitwise_count(px ^ py).sum(1, dtype=np.int64)
    return apart <= nx + ny - 2 * least_overlap(nx, ny, percent)


def _pairs_batch(a, b, kind):
    low, high = np.minimum(a, b), np.maximum(a, b)
    pairs, count = np.unique(np.stack([low, high], 1), axis=0, return_counts=True)
    zero = np.zeros(len(pairs), np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(zero), pa.array(zero),
         pa.array(count.astype(np.int32)), pa.array(zero + kind)],
        ["token", "node", "n", "place", "shared", "kind"])


def _pivot_pairs(percent):
    """Lists of two nodes or more (kind 0), and pairs of their nodes with pivots (kind 1)."""
    def rows(batches):
        for table in W.whole_groups(batches, "token", 1 << 16):
            token, node = table.column("token").to_numpy(), table.column("node").to_numpy()
            n, place = table.column("n").to_numpy(), table.column("place").to_numpy()
            order = np.lexsort((node, token))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(node[order]) != 0) | (np.diff(token[order]) != 0)
            order = order[fresh]
            token, node, n, place = token[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
            edge = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
            length = np.diff(edge, append=len(token))
            many = np.repeat(length > 1, length)
            if not many.any():
                continue
            index = np.flatnonzero(many)
            zero = np.zeros(len(index), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[index]), pa.array(node[index]), pa.array(n[index].astype(np.int32)),
                 pa.array(place[index].astype(np.int32)), pa.array(zero), pa.array(zero)],
                ["token", "node", "n", "place", "shared", "kind"])
            first, size = np.repeat(edge, length), np.repeat(length, length)
            left, right = [], []
            for step in range(PIVOTS):
                pivot = (first + np.minimum(step, size - 1))[index]
                good = (pivot != index) & can_link(n[pivot], n[index], place[pivot], place[index], percent)
                left.append(node[pivot[good]])
                right.append(node[index[good]])
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield _pairs_batch(a, b, 1)
    return rows


def _cross_pairs(percent):
    """All pairs of a list's nodes that lie in different components and pass the filters."""
    def rows(batches):
        held_a, held_b, held = [], [], 0
        for table in W.whole_groups(batches, "token", 1 << 14):
            token, node, comp = (table.column(c).to_numpy() for c in ("token", "node", "comp"))
            n, place = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "place"))
            parity = W.flat(W.column_of(table, "parity"), np.uint8)[0].reshape(len(token), -1)
            order = np.lexsort((n, token))
            token, node, comp, n, place = token[order], node[order], comp[order], n[order], place[order]
            parity = parity[order]
            edge = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
            end = np.repeat(np.append(edge[1:], len(token)), np.diff(edge, append=len(token)))
            # sorted by length: a set's partners of at least its length end where they get too long
            limit = 100 * n // percent
            stop = np.empty(len(token), np.int64)
            for low, high in zip(edge, [*edge[1:], len(token)]):
                stop[low:high] = low + np.searchsorted(n[low:high], limit[low:high], "right")
            many = np.maximum(np.minimum(stop, end) - np.arange(len(token)) - 1, 0)
            at = 0
            while at < len(token):
                upto = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), PAIR_BLOCK, "right")))
                x = np.repeat(np.arange(at, min(upto, len(token))), many[at:upto])
                y = W.ranges(np.arange(at, min(upto, len(token))) + 1, many[at:upto])
                good = (comp[x] != comp[y]) & can_link(n[x], n[y], place[x], place[y], percent)
                x, y = x[good], y[good]
                good = differ_little(parity[x], parity[y], n[x], n[y], percent)
                held_a.append(node[x[good]])
                held_b.append(node[y[good]])
                held += int(good.sum())
                if held >= PAIR_BLOCK:
                    yield _pairs_batch(np.concatenate(held_a), np.concatenate(held_b), 1)
                    held_a, held_b, held = [], [], 0
                at = upto
        if held:
            yield _pairs_batch(np.concatenate(held_a), np.concatenate(held_b), 1)
    return rows


def _suffix_filter(percent):
    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pa_, pb = (W.flat(batch.column(c), np.uint8)[0].reshape(batch.num_rows, -1) for c in ("pa", "pb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            good = differ_little(pa_, pb, na, nb, percent)
            yield batch.select(["a", "b", "shared"]).filter(pa.array(good))
    return rows


def _texts_of_nodes(chosen, size):
    """node, text of the rows that the filter names."""
    def rows(batches):
        for batch, texts in W.sliced(batches):
            keep = np.flatnonzero(chosen.value(_names(batch)))
            if not len(keep):
                continue
            part = batch.take(pa.array(keep))
            nodes = nodes_of(*shingle_sets(W.texts_of(part.column("text")), size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.view(np.int64)), part.column("text")], ["node", "text"])
    return rows


def _verify(size, percent):
    def rows(batches):
        for batch in batches:
            for part, left in W.sliced(iter([batch]), "ta"):
                right = W.texts_of(part.column("tb"))
                sets = []
                for texts in (left, right):
                    shingles, lengths = shingle_sets(texts, size)
                    ends = np.cumsum(lengths)
                    sets.append([shingles[e - m:e] for e, m in zip(ends, lengths)])
                good = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(good))
    return rows


def _verified(pairs: DataFrame, found: DataFrame, firsts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; texts are read again for the nodes in pairs only."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    names = firsts.join(nodes, "node", "left_semi").select("name")
    chosen = found.sparkSession.sparkContext.broadcast(sketch.members(names, "name", MEMBER_CELLS))
    texts = stored(found.mapInArrow(released(_texts_of_nodes(chosen, size)), "node long, text string")
                   .join(nodes, "node", "left_semi").dropDuplicates(["node"]), "pair-texts")
    sides = [texts.select(F.col("node").alias(n), F.col("text").alias("t" + n)) for n in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(
        released(_verify(size, percent)), "a long, b long"), "verified")


def jaccard_join(
    docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per document: doc_id, key, n_shingles, component_id, is_first (one row of each component)."""
    send_code(docs.sparkSession)
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    found = identified(docs, id_col, text_col)
    facts = stored(found.mapInArrow(released(_facts(size)), FACTS), "shingle-facts")
    firsts = stored(
        facts.filter("n > 0").groupBy("node").agg(
            F.min(F.struct("id", "key", "name")).alias("f"), F.min("n").alias("n"), F.min("parity").alias("parity"),
        ).select("node", "n", "parity", "f.*"), "nodes")
    levels = context.broadcast(sketch.frequencies(found.select("text"), _shingles(size), ORDER_CELLS))
    n_tokens = text_bytes(found) / 6 * (1 - percent / 100)
    parts = partitions(docs, n_tokens * 24)
    listed = stored(
        found.select("text").mapInArrow(released(_prefixes(levels, size, percent)), POSTING)
        .repartition(parts, "token").sortWithinPartitions("token")
        .mapInArrow(released(_pivot_pairs(percent)), POSTING + ", shared int, kind int"), "postings")

    pairs = listed.filter("kind = 1").groupBy(F.col("token").alias("a"), F.col("node").alias("b")).agg(
        F.sum("shared").alias("shared"))
    near = stored(_filtered(pairs, firsts, percent), "candidates")
    # a pivot is the lesser node of its pairs, so choosing by the greater one covers every node
    best = near.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "a")), False), 1, TRIES)
                                 .alias("tries")).select("b", F.explode("tries").alias("t")).select("t.a", "b")
    best = stored(best, "tries")
    links = _verified(best, found, firsts, size, percent)
    labels = components(links).select(F.col("u").alias("node"), F.col("v").alias("comp"))

    labelled = listed.filter("kind = 0").select("token", "node", "n", "place").join(
        labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled = stored(labelled, "labelled")
    mixed = stored(labelled.groupBy("token").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter(
        "l < h").select("token"), "mixed")
    sketches = firsts.select("node", "parity")
    cross = (
        labelled.join(mixed, "token", "left_semi").join(sketches, "node")
        .select("token", "node", "n", "place", "comp", "parity")
        .repartition(parts, "token").sortWithinPartitions("token")
        .mapInArrow(released(_cross_pairs(percent)), POSTING + ", shared int, kind int")
        .groupBy(F.col("token").alias("a"), F.col("node").alias("b")).agg(F.sum("shared").alias("shared"))
    )
    tried = best.select("a", "b")
    rest = cross.join(tried, ["a", "b"], "left_anti")
    more = _verified(rest, found, firsts, size, percent)
    stars = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    final = components(stars.unionByName(more)).select(F.col("u").alias("node"), F.col("v").alias("comp"))

    of_node = firsts.select("node", "id", "key").join(final, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = of_node.groupBy("comp").agg(F.min(F.struct("id", "key")).alias("first"))
    placed = stored(of_node.select("node", "comp").join(least, "comp").select(
        "node", F.col("first.id").alias("cid"), F.col("first.key").alias("ckey")), "components")
    out = facts.select("id", "key", "node", "n").join(placed, "node", "left")
    linked = F.col("n") > 0
    return out.select(
        public_id().alias("doc_id"), "key", F.col("n").alias("n_shingles"),
        F.when(linked, public_id("cid")).otherwise(public_id()).alias("component_id"),
        F.when(linked, (F.col("id") == F.col("cid")) & (F.col("key") == F.col("ckey")))
        .otherwise(True).alias("is_first"))


def _filtered(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    sides = [firsts.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("parity").alias("p" + x))
             for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", "shared", "na", "nb", "pa", "pb").mapInArrow(
        released(_suffix_filter(percent)), "a long, b long, shared long")
