"""Packing: documents as token ids, cut into sequences of at most `size` by order-preserving DP.

The ids of a partition's documents, each closed by an end id, form one stream
in the table's order. Cuts may fall at document ends, at sentence ends and on a
coarse grid; the cuts chosen minimise, over a block of the stream, the padding
of all sequences plus a penalty for each cut inside a document (less at a
sentence end). A sequence as long as a power of two needs no padding. With
f(j) the least cost of the stream up to candidate j,

    f(j) = cut(j) + min over i with 0 < j - i <= size of f(i) + size - (j - i),

so the best i is the front of a monotone queue of f(i) + i; exact powers of two
are tried at document ends on top. A partition's last sequence is cut into
powers of two where that costs less than padding it.

Ids come from a public tokenizer whose file is a parameter. Its words are
independent of each other, so equal words are encoded once per worker: words
are split where the tokenizer splits them, hashed, and looked up in a bounded table.

Nothing is shuffled and a task holds one block of tokens. Null text counts as
empty (one piece holding the end id); repeated rows and null ids are packed like
others; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.llm import words as W
from moveproof.llm.frames import released, send_code

SIZE = 4096
END_ID = 2
SENTENCE_PENALTY = 8
CUT_PENALTY = 24
GRID = 256
#: Tokens of the stream that are cut together.
BLOCK = 1 << 19
#: Words a worker remembers; the table is emptied when it is full.
MOST_WORDS = 1 << 22

SENTENCE_ENDS = (".</w>", "!</w>", "?</w>")
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long")

# --- byte classes by which the tokenizer's words are cut: blank, letter, digit, mark, other ---
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0xC3:0xCA] = CLASS[0x80:0xC0] = LETTER  # U+00C0 to U+027F and continuation bytes
CLASS[0x27] = CLASS[0x7C] = OTHER  # contractions and special tokens need their neighbours


def units_of(texts: W.Texts) -> W.Words:
    """Byte ranges that the tokenizer treats apart from each other.

    Words of letters, digits and marks alone are cut between the kinds; a word
    with any other byte stays whole.
    """
    found = W.words_of(texts)
    data = texts.data
    kind = CLASS[data]
    odd = kind == OTHER
    # U+00D7 and U+00F7 are no letters, U+0130 is lower-cased to a letter and a mark
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(odd, out=total[1:])
    whole = total[found.ends] > total[found.starts]
    depth = np.zeros(len(data) + 1, np.int8)
    depth[found.starts[whole]] += 1
    depth[found.ends[whole]] -= 1
    begin = np.zeros(len(data) + 1, bool)
    begin[found.starts] = True
    blank = kind == BLANK
    change = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[1:len(data)] |= change & ~blank[1:] & ~blank[:-1] & (np.cumsum(depth[:-1], dtype=np.int8)[1:] == 0)
    starts = np.flatnonzero(begin[:-1])
    of_word = np.searchsorted(found.starts, starts, "right") - 1
    ends = found.ends[of_word].copy()
    same = of_word[1:] == of_word[:-1]
    ends[:-1][same] = starts[1:][same]
    return W.Words(starts, ends, np.searchsorted(starts, texts.bounds))


class Encoder:
    """Ids of texts; a worker keeps one for each tokenizer file."""

    kept: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.array([i for i in map(self.tokenizer.token_to_id, SENTENCE_ENDS) if i is not None])
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys, words) -> None:
        if len(self.keys) + len(keys) > MOST_WORDS:
            self.clear()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        new = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(new)

    def ids(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and the number of each text's."""
        units = units_of(texts)
        data = texts.data
        hashes = W.span_hashes(W.LOWER[data], units.starts, units.ends)
        keys, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(keys) > MOST_WORDS // 2:
            return self._plain(texts)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            if known.all():
                break
            if len(self.keys) + int((~known).sum()) > MOST_WORDS:
                self.clear()
                known[:] = False
            lows, highs = units.starts[first[~known]], units.ends[first[~known]]
            raw = data.tobytes()
            self._learn(keys[~known], [raw[a:b].decode() for a, b in zip(lows, highs)])
        size, place = self.size[at][where], self.place[at][where]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[W.ranges(place, size)], np.diff(total[units.bounds])

    def _plain(self, texts):
        raw, bounds = texts.data.tobytes(), texts.bounds
        found = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids
                 for a, b in zip(bounds[:-1], bounds[1:])]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size


def cuts(places: np.ndarray, penalty: np.ndarray, whole: np.ndarray, size: int) -> list[int]:
    """Ends of the sequences of a block: indices into `places`, ascending stream positions.

    `places` ends with the block's end; 0 is the block's start. `penalty` is the
    price of a cut at each place, `whole` marks document ends. The last
    sequence is the block's rest; it is not padded here.
    """
    position = [0, *places.tolist()]
    price = [0, *penalty.tolist()]
    ends = [True, *whole.tolist()]
    cost, came = [0.0] * len(position), [0] * len(position)
    queue = deque([0])
    at = {0: 0}
    powers = [1 << k for k in range(5, size.bit_length() - 1) if 1 << k < size]
    value = [0.0] * len(position)
    for j in range(1, len(position)):
        here = position[j]
        low = here - size
        while position[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = value[i] + size - here
        if ends[j]:
            for power in powers:
                k = at.get(here - power)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
            at[here] = j
        cost[j], came[j] = best + price[j], i
        v = value[j] = cost[j] + here
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    # the rest after the cheapest cut within reach of the block's end goes with the next block
    reach = bisect_left(position, position[-1] - size)
    best = min(range(reach, len(position) - 1), key=cost.__getitem__)
    chosen = []
    while best:
        chosen.append(best - 1)
        best = came[best]
    return chosen[::-1]


def tail_lengths(length: int, size: int) -> list[int]:
    """The last sequences of a partition: one, or powers of two where that costs less."""
    if length == 0:
        return []
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    padding = 0 if len(parts) == 1 else size - length
    return parts if (len(parts) - 1) * CUT_PENALTY < padding else [length]


class Stream:
    """Documents that wait to be cut, and the pieces of those that were."""

    def __init__(self, first_id: int, size: int, sentence_ends: np.ndarray):
        self.next_id, self.size, self.sentence_ends = first_id, size, sentence_ends
        self.tokens, self.docs, self.held = [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, 0, len(ids)])  # id, ids already given out, all ids
        self.tokens.append(ids)
        self.held += len(ids)

    def flush(self, final: bool) -> dict[str, list]:
        """Pieces of the sequences that are settled; the rest stays held."""
        if not self.held:
            return {}
        ids = np.concatenate(self.tokens)
        left = np.array([total - given for _, given, total in self.docs])
        doc_ends = np.cumsum(left)
        penalty = np.full(len(ids) + 1, -1, np.int64)
        penalty[GRID::GRID] = CUT_PENALTY
        if len(self.sentence_ends):
            penalty[np.flatnonzero(np.isin(ids, self.sentence_ends)) + 1] = SENTENCE_PENALTY
        penalty[doc_ends] = 0
        penalty[0] = -1
        places = np.flatnonzero(penalty >= 0)
        whole = np.zeros(len(places), bool)
        whole[np.searchsorted(places, doc_ends)] = True
        ends = [int(places[i]) for i in cuts(places, penalty[places], whole, self.size)]
        if final:
            at = ends[-1] if ends else 0
            for part in tail_lengths(len(ids) - at, self.size):
                at += part
                ends.append(at)
        if not ends:
            return {}
        out = self._pieces(ids, doc_ends, np.array(ends))
        stop = ends[-1]
        gone = int(np.searchsorted(doc_ends, stop, "right"))
        if gone < len(self.docs):
            before = int(doc_ends[gone - 1]) if gone else 0
            self.docs[gone][1] += stop - before
        self.docs = self.docs[gone:]
        self.tokens, self.held = [ids[stop:]], len(ids) - stop
        return out

    def _pieces(self, ids, doc_ends, seq_ends):
        stop = seq_ends[-1]
        edges = np.unique(np.concatenate([seq_ends, doc_ends[doc_ends < stop]]))
        starts = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(doc_ends, starts, "right")
        seq = np.searchsorted(seq_ends, starts, "right")
        doc_start, seq_start = np.concatenate([[0], doc_ends])[doc], np.concatenate([[0], seq_ends])[seq]
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        out = {
            "doc_id": [self.docs[d][0] for d in doc.tolist()],
            "start": [self.docs[d][1] + s for d, s in zip(doc.tolist(), (starts - doc_start).tolist())],
            "length": (edges - starts).tolist(),
            "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), edges.tolist())],
            "doc_tokens": [self.docs[d][2] for d in doc.tolist()],
            "sequence_id": (self.next_id + seq).tolist(), "offset": (starts - seq_start).tolist(),
        }
        self.next_id += len(seq_ends)
        return out


def _packed(path, end_id, size):
    names = [part.split()[0] for part in PIECE.split(", ")]

    def rows(batches):
        encoder = Encoder.of(path)
        stream = Stream(TaskContext.get().partitionId() << 40, size, encoder.ends)

        def batch(pieces):
            return pa.RecordBatch.from_arrays([pa.array(pieces[n], pa.int64()) for n in names], names)

        for part, texts in W.sliced(batches):
            ids, sizes = encoder.ids(texts)
            at = 0
            for doc_id, n in zip(part.column("doc_id").to_pylist(), sizes.tolist()):
                stream.add(doc_id, np.append(ids[at:at + n], np.uint32(end_id)))
                at += n
                if stream.held >= BLOCK and (pieces := stream.flush(False)):
                    yield batch(pieces)
        if pieces := stream.flush(True):
            yield batch(pieces)
    return rows


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, size: int = SIZE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The tokenizer's file must stand at the same path on every executor.
    """
    send_code(docs.sparkSession)
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    return found.mapInArrow(released(_packed(tokenizer_path, end_id, size)), PIECE)
