"""Substring dedup: word windows that stand in an earlier document are cut out.

A window is `window` consecutive words of one document. Each word covered by a
window whose word sequence also starts in a document of smaller id is removed;
windows are judged on the input.

Pass 1 builds a count-min sketch of the windows' anchors (the least gram of
each window) per partition and merges them. An anchor's count is at least the
count of any window that has it, so the sketch overestimates window counts.
Pass 2 sends only windows estimated repeated and groups them exactly: windows
of one anchor travel together as one row, and the least id of each window is
found by sorting. A stretch that a text repeats is counted and sent once, with all its
places. Anchors counted `hot` times or more would make large groups;
their windows travel as rows of their own, folded inside each task first.

Null text counts as empty, a null id as the largest, rows that repeat id and
text get the same result. An empty table gives an empty result. Other columns
of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.llm import sketch, words as W
from moveproof.llm.frames import identified, partitions, power_of_two, public_id, released, send_code, stored, text_bytes

WINDOW = 50
GRAM = 18
#: Different stretches (of all texts) with an anchor from which its windows are grouped one by one; bounds
#: a group to this many rows of at most `WINDOW - GRAM + 1` windows.
HOT = 1 << 15
SALTS = 16
#: Bound of the sketch: four bitmaps of this many bits are broadcast.
MOST_CELLS = 1 << 28

RUNS = "anchor long, id long, key long, starts binary, windows binary"
SINGLE = "anchor long, window long, id long, key long, start int"
RESULT = "id long, n_words long, n_removed long, kept_sha256 string"


def _runs(texts, window, gram):
    found = W.words_of(texts)
    hashes = W.word_hashes(texts, found)
    return W.runs_of(hashes, found.bounds, window, gram), found, hashes


def _stretches(runs: W.Runs, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in an order in which a text's equal ones are neighbours, and where each kind begins.

    A run's first and last window together hold all its words.
    """
    if not len(runs.text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = windows[runs.start], windows[runs.start + runs.length - 1]
    parts = (runs.start, last, first, runs.length, runs.anchor, runs.text)
    order = np.lexsort(parts)
    new = np.ones(len(order), bool)
    new[1:] = np.any([part[order][1:] != part[order][:-1] for part in parts[1:]], axis=0)
    return order, np.flatnonzero(new)


def _anchor_hashes(window, gram):
    def hashes_of(batches):
        for _, texts in W.sliced(batches):
            runs, _, hashes = _runs(texts, window, gram)
            order, new = _stretches(runs, W.window_hashes(hashes, window))
            yield runs.anchor[order[new]]
    return hashes_of


def _candidates(seen, window, gram, hot):
    """Runs estimated repeated: whole (hot=False), or as single windows (hot=True)."""
    def rows(batches):
        for batch, texts in W.sliced(batches):
            runs, found, hashes = _runs(texts, window, gram)
            is_hot = seen.value.hot(runs.anchor)
            pick = np.flatnonzero(is_hot if hot else seen.value.repeated(runs.anchor) & ~is_hot)
            if not len(pick):
                continue
            all_windows = W.window_hashes(hashes, window)
            if not hot:
                chosen = W.Runs(*(part[pick] for part in runs))
                order, new = _stretches(chosen, all_windows)
                places = (chosen.start - found.bounds[chosen.text])[order].astype("<i4")
                pick = pick[order[new]]
            length = runs.length[pick]
            windows = all_windows[W.ranges(runs.start[pick], length)]
            start = runs.start[pick] - found.bounds[runs.text[pick]]
            of = runs.text[pick]
            if hot:
                start, of = W.ranges(start, length), np.repeat(of, length)
                anchor = np.repeat(runs.anchor[pick], length)
                last = pa.array(windows.view(np.int64))
                names, order = ["anchor", "window", "id", "key", "start"], (0, 4, 1, 2, 3)
            else:
                anchor, last = runs.anchor[pick], W.binary(windows, length)
                start = W.binary(places, np.diff(new, append=len(places)))
                names, order = ["anchor", "id", "key", "starts", "windows"], (0, 1, 2, 3, 4)
            of = pa.array(of)
            columns = [pa.array(anchor.view(np.int64)), batch.column("id").take(of),
                       batch.column("key").take(of), pa.array(start.astype(np.int32)) if hot else start, last]
            yield pa.RecordBatch.from_arrays([columns[i] for i in order], names)
    return rows


def _later(batches):
    """Windows that an earlier document has too, by whole groups of runs of one anchor."""
    for table in W.whole_groups(batches, "anchor"):
        windows, length = W.flat(W.column_of(table, "windows"), np.uint64)
        ids = np.repeat(table.column("id").to_numpy(), length)
        anchor = np.repeat(table.column("anchor").to_numpy(), length)
        order = np.lexsort((ids, windows, anchor))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(windows[order]) != 0) | (np.diff(anchor[order]) != 0)
        least = ids[order][first][np.cumsum(first) - 1]
        flags = np.zeros(len(order), np.uint8)
        flags[order] = ids[order] > least
        ends = np.cumsum(length)
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        keep = np.flatnonzero(total[ends] > total[ends - length])
        if len(keep):
            picked = flags[W.ranges((ends - length)[keep], length[keep])]
            rest = table.select(["id", "key", "starts"]).take(pa.array(keep)).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [W.column_of(rest, n) for n in ("id", "key", "starts")]
                + [W.binary(picked, length[keep])], ["id", "key", "starts", "flags"])


def _cut(raw: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without each run of removed words and the white space after it."""
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    starts = np.append(starts, len(raw))
    low, high = starts[:-1][edge[:-1] == 1], starts[np.flatnonzero(edge == -1)]
    begin = np.concatenate([[0], high])
    return b"".join(raw[a:b] for a, b in zip(begin, np.append(low, len(raw))))


def _assemble(window, with_text, carried):
    def rows(batches):
        for batch, texts in W.sliced(batches):
            found = W.words_of(texts) if with_text else None
            marks = batch.column("marks")
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for i in range(batch.num_rows):
                raw = texts.data[texts.bounds[i]:texts.bounds[i + 1]].tobytes()
                kept = words = raw.split()
                if marks[i].is_valid:
                    places = [{"start": start, "flags": mark["flags"]} for mark in marks[i].as_py()
                              for start in np.frombuffer(mark["starts"], "<i4").tolist()]
                    gone = W.covered(places, len(words), window)
                    kept = list(compress(words, ~gone))
                    if with_text:
                        starts = found.starts[found.bounds[i]:found.bounds[i + 1]]
                        raw = _cut(raw, starts - texts.bounds[i], gone)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["kept_text"].append(raw.decode() if with_text else None)
            columns = [batch.column("id"), pa.array(out["n_words"], pa.int64()),
                       pa.array(out["n_removed"], pa.int64()),
                       pa.array(out["kept_sha256"], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns += [batch.column("key"), pa.array(out["kept_text"], pa.string())]
                names += ["key", "kept_text"]
            columns += [batch.column(c) for c in carried]
            names += carried
            yield pa.RecordBatch.from_arrays(columns, names)
    return rows


def marked_windows(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """id, key, starts, flags: windows (flag per window from each start) that an earlier document has."""
    spark, size = docs.sparkSession, text_bytes(docs)
    # an anchor for about every (window - gram) / 2 words of six bytes, eight cells for each
    cells = power_of_two(8 * size / (3 * (window - gram + 2)), 1 << 18, most_cells)
    found = sketch.repeats(docs.select("text"), _anchor_hashes(window, gram), cells, hot)
    seen = spark.sparkContext.broadcast(found)
    docs = docs.select("id", "key", "text")
    runs = docs.mapInArrow(released(_candidates(seen, window, gram, False)), RUNS)
    marks = (
        runs.repartition(partitions(docs, size / 2), "anchor").sortWithinPartitions("anchor")
        .mapInArrow(released(_later), "id long, key long, starts binary, flags binary")
    )
    if not found.any_hot:
        return marks
    single = docs.mapInArrow(released(_candidates(seen, window, gram, True)), SINGLE)
    firsts = stored(
        single.groupBy("anchor", "window").agg(F.min("id").alias("first"), F.max("id").alias("_last"))
        .filter("first < _last").drop("_last"), "first-windows")
    # a window that a third of all documents share would be one join key: cut it into SALTS
    salted = firsts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    single = single.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int"))
    later = single.join(salted, ["anchor", "window", "salt"]).filter("id > first")
    # as the bytes of a little-endian number, like the places of whole runs
    place = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("start", 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))
    return marks.unionByName(later.select("id", "key", place.alias("starts"), F.lit(b"\x01").alias("flags")))


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
    most_cells: int = MOST_CELLS, id_col: str = "doc_id", text_col: str = "text",
    with_text: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, then the columns to carry.

    `kept_sha256` is the digest of the kept words joined by one space. With
    `with_text` also `key` (the hash of the input text) and `kept_text`: the
    text with each removed run and the white space after it cut out, all
    else as it was.
    """
    send_code(docs.sparkSession)
    own = {f"carried_{i}": column for i, column in enumerate(carry)}
    found = identified(docs, id_col, text_col, **own)
    marks = marked_windows(found, window, gram, hot, most_cells)
    per_doc = marks.groupBy("id", "key").agg(
        F.collect_list(F.struct("starts", "flags")).alias("marks"))
    schema = RESULT + (", key long, kept_text string" if with_text else "") + "".join(
        f", {name} {found.schema[name].dataType.simpleString()}" for name in own)
    out = found.join(per_doc, ["id", "key"], "left").mapInArrow(
        released(_assemble(window, with_text, list(own))), schema)
    return out.select(public_id().alias("doc_id"), *[
        F.col(c).alias(own.get(c, c)) for c in out.columns if c != "id"])
