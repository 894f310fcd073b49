"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are cut out.

Each byte covered by a string of `length` bytes that starts anywhere else too,
in the same or another text, is removed; strings never cross texts, overlaps
count, and strings are judged on the input.

A window of `length` bytes has as its anchor the least of its grams; equal
windows have equal anchors at equal offsets. A count-min sketch of all anchors
drops the windows whose anchor occurs once. The rest travels as contexts: the
bytes of consecutive windows of one anchor. Contexts of one anchor meet in a
task, where the suffixes that start at the anchor, and the reversed prefixes
that end there, are sorted by a merge sort. Two suffixes are compared by prefix
polynomial hashes: a binary search finds their common extension, the byte after
it decides. Extensions of neighbours are verified byte by byte. A window that
starts d bytes before its anchor equals another if both agree on d bytes
backward and length - d forward, which the two sorted orders tell.

Anchors counted `hot` times or more would make large groups; their windows
travel as single hashes, counted with folding inside each task, which is exact
for any number of them.

Null text counts as empty; rows that repeat id and text are copies of each
other and lose what they share; a null id is kept. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.llm import sketch, words as W
from moveproof.llm.frames import identified, partitions, power_of_two, public_id, released, send_code, stored, text_bytes

LENGTH = 400
GRAM = 145
#: Occurrences of an anchor from which its windows are counted one by one; bounds a group to 11 MB.
HOT = 1 << 14
SALTS = 16
MOST_CELLS = 1 << 28
#: Longer texts are read in pieces of so many window starts.
PIECE = 1 << 22
#: Contexts sorted at a time, and more only to keep an anchor's contexts together.
CONTEXTS = 4096

CONTEXT = "anchor long, id long, key long, start int, back int, context binary"
SINGLE = "anchor long, window long, id long, key long, start int"

BYTE_HASH = W.mix(np.arange(1, 257, dtype=np.uint64))


def _pieces(batches, length):
    """Slices of texts, a very long text in overlapping pieces; with the piece's offset."""
    for batch, texts in W.sliced(batches):
        size = len(texts.data)
        if batch.num_rows > 1 or size <= PIECE + length:
            yield batch, texts, 0
            continue
        for at in range(0, size - length + 1, PIECE):
            part = texts.data[at:at + PIECE + length - 1]
            yield batch, W.Texts(part, np.array([0, len(part)])), at


def _anchor_hashes(length, gram):
    def hashes_of(batches):
        for _, texts, _ in _pieces(batches, length):
            yield W.runs_of(BYTE_HASH[texts.data], texts.bounds, length, gram).anchor
    return hashes_of


def _candidates(seen, length, gram, hot):
    """Contexts of anchors estimated repeated (hot=False), or single windows of hot anchors."""
    def rows(batches):
        for batch, texts, shift in _pieces(batches, length):
            values = BYTE_HASH[texts.data]
            runs = W.runs_of(values, texts.bounds, length, gram)
            is_hot = seen.value.hot(runs.anchor)
            pick = np.flatnonzero(is_hot if hot else seen.value.repeated(runs.anchor) & ~is_hot)
            if not len(pick):
                continue
            first, n, of = runs.start[pick], runs.length[pick], runs.text[pick]
            start = first - texts.bounds[of] + shift
            if hot:
                windows = W.window_hashes(values, length)[W.ranges(first, n)]
                names = ["anchor", "window", "id", "key", "start"]
                owner = pa.array(np.repeat(of, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(runs.anchor[pick], n).view(np.int64)), pa.array(windows.view(np.int64)),
                     batch.column("id").take(owner), batch.column("key").take(owner),
                     pa.array(W.ranges(start, n).astype(np.int32))], names)
                continue
            size = n + length - 1
            names = ["anchor", "id", "key", "start", "back", "context"]
            owner = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs.anchor[pick].view(np.int64)), batch.column("id").take(owner),
                 batch.column("key").take(owner), pa.array(start.astype(np.int32)),
                 pa.array((runs.at[pick] - first).astype(np.int32)),
                 W.binary(texts.data[W.ranges(first, size)], size)], names)
    return rows


class Suffixes:
    """Suffixes of a buffer from given positions: `step` 1 reads forward, -1 backward.

    Suffix i has the bytes at positions[i], positions[i] + step, ..., lengths[i]
    of them; those of one group are contiguous in the arrays.
    """

    def __init__(self, data, prefix, positions, lengths, step):
        self.data, self.prefix, self.step = data, prefix, step
        self.positions, self.lengths = positions, lengths
        self.down = W.powers(len(data) + 1, "down")

    def _hashes(self, i, n):
        low = self.positions[i] if self.step > 0 else self.positions[i] - n
        return (self.prefix[low + n] - self.prefix[low]) * self.down[low]

    def _byte(self, i, n):
        at = self.positions[i] + n if self.step > 0 else self.positions[i] - n - 1
        return self.data[np.clip(at, 0, len(self.data) - 1)]

    def common(self, i, j):
        """Length of the common extension of suffixes i and j, by binary search on hashes."""
        high = np.minimum(self.lengths[i], self.lengths[j])
        low = np.zeros_like(high)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self._hashes(i, middle) == self._hashes(j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i, j, or_equal):
        n = self.common(i, j)
        ends_i, ends_j = n == self.lengths[i], n == self.lengths[j]
        return np.where(ends_i | ends_j, np.where(ends_i & ends_j, or_equal, ends_i),
                        self._byte(i, n) < self._byte(j, n))

    def sorted(self, group_start, group_size):
        """Order of the suffixes within their groups: merge sort, all merges of a level at once."""
        total = len(self.positions)
        order = np.arange(total)
        at = order - group_start
        width = 1
        while (group_size > width).any():
            active = np.flatnonzero(group_size > width)
            block = group_start[active] + at[active] // (2 * width) * (2 * width)
            in_left = active - block < width
            other = np.where(in_left, block + width, block)
            end = group_start[active] + group_size[active]
            low, high = other.copy(), np.maximum(np.minimum(other + width, end), other)
            mine = order[active]
            # a left element goes after right ones that are less, a right one also after equal left ones
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                theirs = order[middle]
                before = self.less(theirs, mine[open_], ~in_left[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            own = np.where(in_left, active - block, active - block - width)
            target = block + own + (low - other)
            merged = order.copy()
            merged[target] = mine
            order = merged
            width *= 2
        return order

    def neighbours(self, order, group_start):
        """Common extension of each suffix with the one sorted before it, -1 for a group's first; verified."""
        out = np.full(len(order), -1)
        inner = np.flatnonzero(np.arange(len(order)) != group_start)
        i, j = order[inner - 1], order[inner]
        found = self.common(i, j)
        back = found if self.step < 0 else 0
        a = self.data[W.ranges(self.positions[i] - back, found)]
        b = self.data[W.ranges(self.positions[j] - back, found)]
        for k in np.unique(np.searchsorted(np.cumsum(found), np.flatnonzero(a != b), "right")):
            x, y = (self.data[self.positions[s]:self.positions[s] + found[k]][::1] if self.step > 0
                    else self.data[self.positions[s] - found[k]:self.positions[s]][::-1] for s in (i[k], j[k]))
            found[k] = np.flatnonzero(x != y)[0]
        out[inner] = found
        return out


def repeated_windows(data, sizes, back, group, length, gram):
    """For contexts (sorted by group) which of their windows equal a window of another context."""
    n = len(sizes)
    offsets = np.cumsum(sizes) - sizes
    anchor = offsets + back
    edge = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(edge, append=n)
    group_start, group_size = np.repeat(edge, size), np.repeat(size, size)
    prefix = W.prefix_hashes(BYTE_HASH[data])
    classes = []
    for lengths, step in ((offsets + sizes - anchor, 1), (back, -1)):
        suffixes = Suffixes(data, prefix, anchor, lengths, step)
        order = suffixes.sorted(group_start, group_size)
        classes.append((order, suffixes.neighbours(order, group_start)))
    (forward, forward_common), (backward, backward_common) = classes
    windows = sizes - length + 1
    window_offset = np.cumsum(windows) - windows
    flags = np.zeros(int(windows.sum()), np.uint8)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(length - gram + 1):
        active = np.flatnonzero((back >= d) & (back - d < windows) & (group_size > 1))
        if not len(active):
            continue
        ahead[forward] = np.cumsum(forward_common < length - d)
        behind[backward] = np.cumsum(backward_common < d)
        both = ahead[active] * (n + 1) + behind[active]
        order = np.argsort(both, kind="stable")
        same = np.diff(both[order]) == 0
        twice = np.zeros(len(order), bool)
        twice[1:] = same
        twice[:-1] |= same
        hit = active[order[twice]]
        flags[window_offset[hit] + back[hit] - d] = 1
    return flags, windows


def _compare(length, gram):
    def rows(batches):
        for table in W.whole_groups(batches, "anchor", CONTEXTS):
            group = table.column("anchor").to_numpy()
            same = np.diff(group) == 0
            many = np.zeros(len(group), bool)
            many[1:] = same
            many[:-1] |= same
            if not many.any():
                continue
            table = table.filter(pa.array(many)).combine_chunks()
            data, sizes = W.flat(W.column_of(table, "context"), np.uint8)
            back = table.column("back").to_numpy().astype(np.int64)
            flags, windows = repeated_windows(data, sizes, back, group[many], length, gram)
            ends = np.cumsum(windows)
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            keep = np.flatnonzero(total[ends] > total[ends - windows])
            if len(keep):
                rest = table.select(["id", "key", "start"]).take(pa.array(keep))
                picked = flags[W.ranges((ends - windows)[keep], windows[keep])]
                yield pa.RecordBatch.from_arrays(
                    [W.column_of(rest, c) for c in ("id", "key", "start")] + [W.binary(picked, windows[keep])],
                    ["id", "key", "start", "flags"])
    return rows


def marked_windows(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, most_cells: int = MOST_CELLS
) -> DataFrame:
    """id, key, start, flags: windows (flag per window from `start`) that start elsewhere too."""
    size = text_bytes(docs)
    # an anchor for about every (length - gram) / 2 bytes, eight cells for each
    cells = power_of_two(16 * size / (length - gram + 2), 1 << 18, most_cells)
    found = sketch.repeats(docs.select("text"), _anchor_hashes(length, gram), cells, hot)
    seen = docs.sparkSession.sparkContext.broadcast(found)
    marks = (
        docs.mapInArrow(released(_candidates(seen, length, gram, False)), CONTEXT)
        .repartition(partitions(docs, 1.5 * size), "anchor").sortWithinPartitions("anchor")
        .mapInArrow(released(_compare(length, gram)), "id long, key long, start int, flags binary")
    )
    if not found.any_hot:
        return marks
    single = docs.mapInArrow(released(_candidates(seen, length, gram, True)), SINGLE)
    twice = stored(single.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                   .select("anchor", "window"), "repeated-windows")
    salted = twice.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    single = single.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int"))
    again = single.join(salted, ["anchor", "window", "salt"])
    return marks.unionByName(again.select("id", "key", "start", F.lit(b"\x01").alias("flags")))


def _assemble(length, with_bytes):
    def rows(batches):
        for batch, texts in W.sliced(batches):
            marks = batch.column("marks")
            removed, spans, digests, kept_bytes = [], [], [], []
            for i in range(batch.num_rows):
                data = texts.data[texts.bounds[i]:texts.bounds[i + 1]]
                kept, gone = data, None
                if marks[i].is_valid:
                    gone = W.covered(marks[i].as_py(), len(data), length)
                    kept = data[~gone]
                raw = kept.tobytes()
                removed.append(len(data) - len(kept))
                spans.append(0 if gone is None else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(raw).hexdigest())
                kept_bytes.append(raw if with_bytes else None)
            columns = [batch.column("id"), pa.array(np.diff(texts.bounds)), pa.array(removed, pa.int64()),
                       pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns += [batch.column("key"), pa.array(kept_bytes, pa.binary())]
                names += ["key", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return rows


def dedup_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, most_cells: int = MOST_CELLS,
    id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request key and kept bytes."""
    send_code(docs.sparkSession)
    found = identified(docs, id_col, text_col)
    marks = marked_windows(found, length, gram, hot, most_cells)
    per_doc = marks.groupBy("id", "key").agg(F.collect_list(F.struct("start", "flags")).alias("marks"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", key long, kept binary" if with_bytes else "")
    out = found.join(per_doc, ["id", "key"], "left").mapInArrow(released(_assemble(length, with_bytes)), schema)
    return out.select(public_id().alias("doc_id"), *[c for c in out.columns if c != "id"])
