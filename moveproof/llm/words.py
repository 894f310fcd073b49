"""Words, hashes and windows of many texts at once, as numpy arrays inside a task.

A word is a run of bytes other than space and 0x09-0x0D. All separators are
ASCII, so words of UTF-8 bytes are the words of the characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


class Texts(NamedTuple):
    """Concatenated UTF-8 bytes; text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Byte ranges of all words; text i has words bounds[i] to bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """Bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[bounds[0]:bounds[-1]], bounds - bounds[0])


def sliced(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut to about `limit` bytes of text, so arrays per byte stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = texts_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(texts.bounds, texts.bounds[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            low, high = texts.bounds[at], texts.bounds[to]
            yield batch.slice(at, to - at), Texts(
                texts.data[low:high], texts.bounds[at:to + 1] - low)
            at = to


def words_of(texts: Texts) -> Words:
    data, bounds = texts
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[edges] = inside[edges]
    edges = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds))


MARKS = np.zeros(256, bool)
MARKS[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = True


def trimmed(texts: Texts, found: Words) -> Words:
    """Words without up to three ASCII marks at either end; one byte at least stays."""
    starts, ends = found.starts.copy(), found.ends.copy()
    if len(starts):
        for _ in range(3):
            starts += MARKS[texts.data[starts]] & (starts < ends - 1)
            ends -= MARKS[texts.data[ends - 1]] & (starts < ends - 1)
    return Words(starts, ends, found.bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    out = mix(eight[starts] & _KEEP[np.minimum(ends - starts, 8)] ^ (length << np.uint64(56)))
    at, more = starts + 8, np.flatnonzero(ends - starts > 8)
    while len(more):
        left = ends[more] - at[more]
        chunk = eight[at[more]] & _KEEP[np.minimum(left, 8)]
        out[more] = mix((out[more] + np.uint64(0x9E3779B97F4A7C15)) ^ chunk)
        at[more] += 8
        more = more[left > 8]
    return out


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    return span_hashes(texts.data, words.starts, words.ends)


def powers(n: int, kind: str) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64 ("up"), or of its inverse ("down")."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        size = 1 << max(16, (n - 1).bit_length())
        factors = np.full(size, base & _MASK, np.uint64)
        factors[0] = 1
        _powers[kind] = np.multiply.accumulate(factors)
    return _powers[kind][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P[i] = sum of values[t] * base**t for t < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), "up"), out=out[1:])
    return out


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = prefix_hashes(values)
    return mix((prefix[size:] - prefix[:n]) * powers(n, "down"))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(out) - (width - have)], out[width - have:]) if have < width else out


_INDEX_BITS = 26
_BLOCK = 1 << 25


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive grams the position of the least one, the leftmost of equals.

    It depends on the grams in the window alone, so equal windows have their
    anchor at the same place wherever they stand.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << _INDEX_BITS) - 1)
    out = []
    for at in range(0, n, _BLOCK):
        part = grams[at:min(at + _BLOCK, n) + width - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(key, width) & low).astype(np.int64) + at)
    return np.concatenate(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, concatenated."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of consecutive stretches of an array; lengths in elements."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * data.itemsize, out=offsets[1:])
    flat = np.ascontiguousarray(data)
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [
        None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column, and the number in each row."""
    texts = texts_of(column)
    size = np.dtype(dtype).itemsize
    return texts.data.view(dtype) if size == 1 else np.frombuffer(
        texts.data.tobytes(), dtype), np.diff(texts.bounds) // size


class Runs(NamedTuple):
    """Consecutive windows of one text that share an anchor."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    anchor: np.ndarray
    at: np.ndarray


def runs_of(values: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Runs:
    """Windows of `window` values inside each text, cut into runs of one anchor.

    The anchor is the least `gram` of the window (its hash is `anchor`, its
    position `at`). Equal windows have equal anchors, so a window can repeat
    only if its anchor does, and only runs of equal anchor need comparing.
    Positions are those in `values`.
    """
    grams = window_hashes(values, gram)
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    at = ranges(bounds[:-1], counts)
    chosen = anchors(grams, window - gram + 1)[at]
    edge = np.flatnonzero(np.diff(chosen, prepend=-1))
    text = np.searchsorted(np.cumsum(counts), edge, "right")
    length = np.diff(edge, append=len(at))
    return Runs(text, at[edge], length, grams[chosen[edge]], chosen[edge])


def whole_groups(
    batches: Iterator[pa.RecordBatch], column: str, rows: int = 4096
) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by a long column, some `rows` at a time."""
    held, n, want = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < want:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(column).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held, n = table.slice(cut).to_batches(), n - cut
        want = max(rows, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column_of(table: pa.Table, name: str) -> pa.Array:
    """A column of a table in one piece."""
    found = table.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def covered(marks: list[dict], n: int, window: int) -> np.ndarray:
    """Which of n places are covered by marked windows; a mark has a start and flags from there."""
    starts = np.zeros(n + window, np.int32)
    for mark in marks:
        starts[mark["start"] + np.flatnonzero(np.frombuffer(mark["flags"], np.uint8)) + window] = 1
    total = np.cumsum(starts)
    return total[window:] > total[:n]
