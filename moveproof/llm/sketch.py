"""Count-min sketch of 64-bit hashes over a whole table, merged from sketches of its partitions.

The sketch has a fixed number of rows and a number of cells that the caller
derives from the data up to a stated bound. A cell's count is never below the
true count of any hash in it, so "estimated repeated" misses no repeat; with
too few cells more hashes pass, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.llm.frames import released
from moveproof.llm.words import mix

ROWS = 2
BLOCK_BITS = 18
FLUSH = 1 << 21
#: Arrays that one task merges.
FAN = 32
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes ^ np.uint64(SEEDS[row])) >> np.uint64(64 - bits)


class Repeats:
    """Bits of the merged sketch: cells counted twice or more, and `hot` times or more."""

    def __init__(self, bits: int, twice: list[np.ndarray], often: list[np.ndarray]):
        self.bits, self.twice, self.often = bits, twice, often

    def _all(self, maps, hashes):
        out = np.ones(len(hashes), bool)
        for row, bitmap in enumerate(maps):
            cell = cells_of(hashes, row, self.bits)
            out &= (bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        return self._all(self.twice, hashes)

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._all(self.often, hashes)

    @property
    def any_hot(self) -> bool:
        return any(b.any() for b in self.often)


def folded(
    partial: DataFrame, by: str, merge: Callable[[pa.Table], pa.Table], schema: str,
    last: Callable[[pa.Table], pa.Table] | None = None, last_schema: str = "",
    tasks: int = FAN ** 3,
) -> DataFrame:
    """One row for each value of `by`, merged from the rows of all tasks in levels.

    `merge` makes one row of some rows of equal `by`, in the same layout; `last`,
    if given, makes the result of what is left. Tasks of neighbouring numbers are merged
    FAN at a time, then FAN of the results, then the rest, so a group holds FAN
    arrays up to FAN**3 tasks. With a known number of tasks only the levels that it needs are run.
    """
    def level(table):
        return merge(table).append_column("_at", table.column("_at")[:1])

    rows = partial.withColumn("_at", F.spark_partition_id())
    for depth in (1, 2):
        if tasks <= FAN ** depth:
            break
        rows = rows.withColumn("_at", F.floor(F.col("_at") / FAN).cast("int")).groupBy(by, "_at").applyInArrow(
            level, f"{schema}, _at int")
    return rows.drop("_at").groupBy(by).applyInArrow(last or merge, last_schema or schema)


def _packed(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per touched block: offsets of its cells and their counts."""
    block, offsets, counts = [], [], []
    block_bits = min(BLOCK_BITS, bits)
    for row in range(ROWS):
        cell, count = np.unique(cells_of(hashes, row, bits), return_counts=True)
        of = (cell >> np.uint64(block_bits)).astype(np.int64)
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        for low, high in zip(edge, [*edge[1:], len(of)]):
            block.append(row << 40 | int(of[low]))
            inside = cell[low:high] & np.uint64((1 << block_bits) - 1)
            offsets.append(inside.astype("<u4").tobytes())
            counts.append(np.minimum(count[low:high], 65535).astype("<u2").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(offsets, pa.binary()),
         pa.array(counts, pa.binary())], ["block", "cells", "counts"])


def repeats(
    df: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]],
    cells: int, hot: int,
) -> Repeats:
    """The merged sketch of all hashes that `hashes_of` yields for the frame's batches.

    Each task counts its own hashes and sends the touched cells; blocks of
    cells are summed apart from one another. What reaches the driver is four
    bitmaps of `cells` bits, whatever the input.
    """
    bits = cells.bit_length() - 1
    block_bits = min(BLOCK_BITS, bits)

    def count(batches):
        held, size = [], 0
        for hashes in hashes_of(batches):
            held.append(hashes)
            size += len(hashes)
            if size >= FLUSH:
                yield _packed(np.concatenate(held), bits)
                held, size = [], 0
        if size:
            yield _packed(np.concatenate(held), bits)

    def summed(cells, counts):
        total = np.zeros(1 << block_bits, np.int64)
        for cell, n in zip(cells, counts):
            at = np.frombuffer(cell.as_buffer(), "<u4")
            total[at] += np.frombuffer(n.as_buffer(), "<u2")
        return total

    def merge(table):
        total = summed(table.column("cells"), table.column("counts"))
        at = np.flatnonzero(total)
        return pa.table({"block": table.column("block")[:1], "cells": pa.array([at.astype("<u4").tobytes()]),
                         "counts": pa.array([np.minimum(total[at], 65535).astype("<u2").tobytes()])})

    def bitmaps(table):
        total = summed(table.column("cells"), table.column("counts"))
        maps = [np.packbits(total >= least, bitorder="little").tobytes() for least in (2, min(hot, 65535))]
        return pa.table({"block": table.column("block")[:1],
                         "twice": pa.array([maps[0]]), "often": pa.array([maps[1]])})

    layout = "block long, cells binary, counts binary"
    merged = folded(df.mapInArrow(released(count), layout), "block", merge, layout,
                    bitmaps, "block long, twice binary, often binary")
    size = max(1, cells // 8)
    twice, often = ([np.zeros(size, np.uint8) for _ in range(ROWS)] for _ in range(2))
    step = max(1, (1 << block_bits) // 8)
    for found in merged.collect():
        row, at = found["block"] >> 40, (found["block"] & ((1 << 40) - 1)) * step
        twice[row][at:at + step] = np.frombuffer(found["twice"], np.uint8)[:step]
        often[row][at:at + step] = np.frombuffer(found["often"], np.uint8)[:step]
    return Repeats(bits, twice, often)


def frequencies(
    df: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int
) -> np.ndarray:
    """Counts per cell of a one-row sketch of `cells` cells; a task sends each cell once."""
    bits = cells.bit_length() - 1
    block = min(1 << BLOCK_BITS, cells)

    def count(batches):
        total = np.zeros(cells, np.int64)
        for hashes in hashes_of(batches):
            total += np.bincount(cells_of(hashes, 0, bits).astype(np.int64), minlength=cells)
        if total.any():
            small = np.minimum(total, 0xFFFFFFFF).astype("<u4").reshape(-1, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(small)), pa.int64()), pa.array([r.tobytes() for r in small])],
                ["block", "counts"])

    def merge(table):
        total = np.zeros(block, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_buffer(), "<u4")
        total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()])})

    layout = "block long, counts binary"
    merged = folded(df.mapInArrow(released(count), layout), "block", merge, layout)
    out = np.zeros((cells // block, block), np.uint32)
    for found in merged.collect():
        out[found["block"]] = np.frombuffer(found["counts"], "<u4")
    return out.reshape(-1)


class Members:
    """A Bloom filter with one hash over `cells` bits; it may say yes for a stranger, never no for a member."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        cell = cells_of(hashes, 0, self.bits)
        return (self.bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def members(df: DataFrame, column: str, cells: int) -> Members:
    """A filter for the values of a long column, built per block of cells and of fixed size."""
    bits = cells.bit_length() - 1
    block_bits = min(BLOCK_BITS, bits)
    size = max(1, (1 << block_bits) // 8)

    def mark(batches):
        held = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        cell = np.unique(cells_of(np.concatenate(held), 0, bits)) if held else np.zeros(0, np.uint64)
        of = (cell >> np.uint64(block_bits)).astype(np.int64)
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        inside = (cell & np.uint64((1 << block_bits) - 1)).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[edge]), pa.array([inside[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(of)])],
                                          pa.binary())], ["block", "cells"])

    def seen(cells):
        out = np.zeros(1 << block_bits, bool)
        for cell in cells:
            out[np.frombuffer(cell.as_buffer(), "<u4")] = True
        return out

    def merge(table):
        at = np.flatnonzero(seen(table.column("cells"))).astype("<u4")
        return pa.table({"block": table.column("block")[:1], "cells": pa.array([at.tobytes()])})

    def bitmaps(table):
        packed = np.packbits(seen(table.column("cells")), bitorder="little").tobytes()
        return pa.table({"block": table.column("block")[:1], "bitmap": pa.array([packed])})

    layout = "block long, cells binary"
    merged = folded(df.select(column).mapInArrow(released(mark), layout), "block", merge, layout,
                    bitmaps, "block long, bitmap binary")
    bitmap = np.zeros(max(1, cells // 8), np.uint8)
    for found in merged.collect():
        bitmap[found["block"] * size:(found["block"] + 1) * size] = np.frombuffer(found["bitmap"], np.uint8)
    return Members(bits, bitmap)
