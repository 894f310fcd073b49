"""Source divergence audit: how far the word use of each source lies from the others of its language.

Single-pass in-memory indexing: a task reads its documents once and gathers
postings (language, term, source: documents, occurrences) until the block is
full, then spills it as a term-sorted run to the shared folder, cut by hash
shard. Each shard's runs are heap-merged into frequencies: blocks arrive in the
order of their first key, and what lies before the next block's first key is
final, so a task holds the open blocks and no more.

A group is a (language, source). Each language keeps the terms of at least
`min_docs` of its documents. A group gives a kept term the share
p = 1 + floor(SCALE * (count + 1) / (n + v)), n its occurrences of kept terms
and v their number; f(p, q) = floor((p - q)**2 / q). Part `pair` sums f over all kept
terms against every other source of the language: the sum if no term
occurred, plus a correction for each term of one side alone, taken by count
and not by term, plus the corrections streamed over the postings of terms that
both sides have. Part `term` lists the terms a group has more than its language.

Whole numbers throughout; occurrences of a group up to 9 * 10**15. Null text,
language and source count as empty. Every row is a document, repeated rows too.
A group without kept terms still has shares; a language without kept terms has
values of 0. A long text stays whole within a task. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveproof.llm import words as W
from moveproof.llm.frames import released, send_code, stored

SCALE = 1_000_000_000
#: A block is spilled at this many postings, or octets of them.
BLOCK = 1 << 18
BLOCK_BYTES = 32 << 20
#: Postings in a packed piece of a run.
PIECE = 4096
#: Postings merged, and paired, at a time; sources of a language paired at a time.
MERGE = 1 << 17
PAIR = 1 << 16
SIDE = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POSTING = pa.schema([("key", pa.binary()), ("source", pa.binary()), ("docs", pa.int64()), ("count", pa.int64())])
RUN = "shard int, first binary, octets int, postings binary"
_CODEC = "zstd"
FREQUENCY = "lang string, term string, source string, count long, total long, sources int, leads int"


def _folded(tables: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(tables)
    table = table.group_by(["key", "source"]).aggregate([("docs", "sum"), ("count", "sum")])
    return table.select(["key", "source", "docs_sum", "count_sum"]).rename_columns(_POSTING.names)


def _postings(batch: pa.RecordBatch, texts: W.Texts) -> pa.Table:
    """Postings of some documents; each group has one with an empty term and no count."""
    langs, sources = (batch.column(c).cast(pa.binary()).dictionary_encode() for c in ("lang", "source"))
    pairs = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    groups, group = np.unique(pairs, return_inverse=True)
    lang, source = groups // len(sources.dictionary), groups % len(sources.dictionary)
    data = np.where(_LETTER[texts.data], W.LOWER[texts.data], 0x20).astype(np.uint8)
    found = W.words_of(W.Texts(data, texts.bounds))
    sizes = found.ends - found.starts
    terms = W.binary(data[W.ranges(found.starts, sizes)], sizes).cast(pa.large_binary()).dictionary_encode()
    n = max(len(terms.dictionary), 1)
    doc = np.repeat(np.arange(len(group)), np.diff(found.bounds))
    term = terms.indices.to_numpy().astype(np.int64)
    keys, count = np.unique(group[doc] * n + term, return_counts=True)
    once = np.unique(doc * n + term)
    _, docs = np.unique(group[once // n] * n + once % n, return_counts=True)
    at = np.concatenate([keys // n, np.arange(len(groups))])
    name = pa.concat_arrays([terms.dictionary.take(pa.array(keys % n)).cast(pa.binary()),
                             pa.array([b""] * len(groups), pa.binary())])
    none = np.zeros(len(groups), np.int64)
    return pa.table([
        pc.binary_join_element_wise(langs.dictionary.take(pa.array(lang[at])), name, b"\0"),
        sources.dictionary.take(pa.array(source[at])), np.concatenate([docs, none]), np.concatenate([count, none]),
    ], schema=_POSTING)


def _spilled(block: pa.Table, shards: int):
    """The block as a term-sorted run, in packed pieces of one shard each."""
    spans = W.texts_of(W.column_of(block, "key"))
    shard = (W.span_hashes(spans.data, spans.bounds[:-1], spans.bounds[1:]) % np.uint64(shards)).astype(np.int32)
    block = block.append_column("shard", pa.array(shard)).sort_by([
        ("shard", "ascending"), ("key", "ascending"), ("source", "ascending")]).combine_chunks()
    shard = block.column("shard").to_numpy()
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    cuts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(cuts, [*cuts[1:], len(shard)])])
    pieces, codec = list(zip(cuts, [*cuts[1:], len(shard)])), pa.Codec(_CODEC)
    for at in range(0, len(pieces), 64):
        rows = []
        for a, b in pieces[at:at + 64]:
            piece = pa.RecordBatch.from_arrays(
                [W.column_of(block.slice(a, b - a), c) for c in _POSTING.names], schema=_POSTING)
            packed = piece.serialize()
            rows.append((int(shard[a]), piece.column(0)[0].as_py(), packed.size, codec.compress(packed, asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows), (pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ["shard", "first", "octets", "postings"])


def _indexed(shards: int, block: int):
    def runs(batches):
        held, rows, size = [], 0, 0
        for batch, texts in W.sliced(batches):
            held.append(_postings(batch, texts))
            rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
            if rows >= block or size >= BLOCK_BYTES:
                held = [_folded(held)]
                rows, size = held[0].num_rows, held[0].nbytes
                if rows >= block // 2 or size >= BLOCK_BYTES // 2:
                    yield from _spilled(held.pop(), shards)
                    rows, size = 0, 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _spilled(_folded(held), shards)
    return runs


def _below(pieces: list, limit: bytes | None) -> pa.Table:
    """Takes the postings with keys under the limit out of a heap of (next key, number, piece)."""
    taken = []
    while pieces and (limit is None or pieces[0][0] < limit):
        _, number, piece = heapq.heappop(pieces)
        cut = piece.num_rows if limit is None else pc.sum(pc.less(piece.column(0), pa.scalar(limit, pa.binary()))).as_py()
        taken.append(pa.Table.from_batches([piece.slice(0, cut)]))
        if cut < piece.num_rows:
            heapq.heappush(pieces, (piece.column(0)[cut].as_py(), number, piece.slice(cut)))
    return pa.concat_tables(taken) if taken else _POSTING.empty_table()


def _frequencies(postings: pa.Table, min_docs: int) -> pa.RecordBatch | None:
    """Whole terms with their counts per source, of enough documents; and the rows that only name a group."""
    table = _folded([postings]).sort_by([("key", "ascending"), ("source", "ascending")]).combine_chunks()
    coded = W.column_of(table, "key").dictionary_encode()
    start = np.flatnonzero(np.diff(coded.indices.to_numpy(), prepend=-1))
    if not len(start):
        return None
    names = [k.rpartition(b"\0") for k in coded.dictionary.to_pylist()]
    sizes = np.diff(start, append=table.num_rows)
    count = table.column("count").to_numpy()
    marks = np.array([not term for _, _, term in names])
    keep = marks | (np.add.reduceat(table.column("docs").to_numpy(), start) >= min_docs)
    rows = np.flatnonzero(np.repeat(keep, sizes))
    if not len(rows):
        return None
    of = np.repeat(np.arange(len(start)), sizes)[rows]
    total, leads = np.add.reduceat(count, start), np.zeros(table.num_rows, np.int32)
    leads[start[~marks]] = 1
    text = lambda part: pa.array([n[part] for n in names], pa.binary()).take(pa.array(of)).cast(pa.string())
    return pa.RecordBatch.from_arrays([
        text(0), text(2), W.column_of(table, "source").take(pa.array(rows)).cast(pa.string()), pa.array(count[rows]),
        pa.array(total[of]), pa.array(np.where(marks, 0, sizes)[of].astype(np.int32)), pa.array(leads[rows]),
    ], ["lang", "term", "source", "count", "total", "sources", "leads"])


def _merged(min_docs: int, merge: int):
    def frequencies(batches):
        pieces, held, number, codec = [], 0, 0, pa.Codec(_CODEC)
        for batch in batches:
            for first, octets, packed in zip(*(batch.column(c).to_pylist() for c in ("first", "octets", "postings"))):
                if held >= merge and first > pieces[0][0]:
                    done = _below(pieces, first)
                    held -= done.num_rows
                    if (out := _frequencies(done, min_docs)) is not None:
                        yield out
                piece = pa.ipc.read_record_batch(codec.decompress(packed, octets), _POSTING)
                heapq.heappush(pieces, (first, number, piece))
                held, number = held + piece.num_rows, number + 1
        if (out := _frequencies(_below(pieces, None), min_docs)) is not None:
            yield out
    return frequencies


def term_frequencies(
    docs: DataFrame, min_docs: int = 3, text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", block: int = BLOCK, merge: int = MERGE,
) -> DataFrame:
    """lang, term, source, count, total, sources, leads: occurrences of kept terms, stored.

    `total` is the term's count in the language, `leads` is 1 on one row of each
    term. Each group also has a row with an empty term.
    """
    spark = docs.sparkSession
    send_code(spark)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = stored(docs.mapInArrow(released(_indexed(shards, block)), RUN), "runs")
    runs = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("first")
    runs = runs.select("first", "octets", "postings")
    return stored(runs.mapInArrow(released(_merged(min_docs, merge)), FREQUENCY), "frequencies")


def _share(count: str, whole: str) -> Column:
    """1 + floor(SCALE * count / whole) by long division, three digits at a time; count <= whole."""
    quotient, rest = [], f"({count})"
    for _ in range(3):
        quotient.append(f"({rest} * 1000L) div ({whole})")
        rest = f"(({rest} * 1000L) % ({whole}))"
    return F.expr(f"1L + ({quotient[0]}) * 1000000L + ({quotient[1]}) * 1000L + ({quotient[2]})")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _both_sides(side: int):
    """Corrections for terms that both sources of a pair have, summed over some terms at a time."""
    def pairs(batches):
        for table in W.whole_groups(batches, "tid", PAIR):
            langs = W.column_of(table, "lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = table.filter(pa.array(langs.indices.to_numpy() == code)).combine_chunks()
                terms = W.column_of(rows, "term").dictionary_encode().indices.to_numpy()
                coded = W.column_of(rows, "source").dictionary_encode()
                names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                p, p0 = rows.column("p").to_numpy(), np.zeros(len(names), np.int64)
                p0[source] = rows.column("p0").to_numpy()
                wide = max(1, (1 << 21) // min(side, len(names)))
                sums = {}
                for low in range(0, int(terms.max()) + 1, wide):
                    here = (terms >= low) & (terms < low + wide)
                    blocks = {}
                    for b in np.unique(source[here] // side):
                        mine = here & (source // side == b)
                        dense = np.zeros((min(side, len(names) - b * side), wide), np.int64)
                        dense[source[mine] - b * side, terms[mine] - low] = p[mine]
                        blocks[int(b)] = dense
                    for a, left in blocks.items():
                        for b, right in blocks.items():
                            total = sums.setdefault((a, b), np.zeros((len(left), len(right)), np.int64))
                            for i in range(len(left)):
                                has = np.flatnonzero(left[i])
                                q = right[:, has]
                                both, q = q > 0, np.maximum(q, 1)
                                x, x0 = left[i, has][None], p0[a * side + i]
                                q0 = p0[b * side:b * side + len(right)][:, None]
                                gain = _gaps(x, q) - _gaps(x, q0) - _gaps(x0, q) + _gaps(x0, q0)
                                total[i] += np.where(both, gain, 0).sum(1)
                for (a, b), total in sums.items():
                    i, j = np.nonzero(total)
                    apart = a * side + i != b * side + j
                    i, j = i[apart], j[apart]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(i), pa.string()), pa.array([names[a * side + x] for x in i], pa.string()),
                        pa.array([names[b * side + x] for x in j], pa.string()), pa.array(total[i, j])],
                        ["lang", "source", "item", "value"])
    return pairs


def _pair_part(found: DataFrame, groups: DataFrame, side: int) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    empty = groups.join(other, "lang").filter(apart).select(
        "lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _gap("p0", "q0")).otherwise(0).alias("value"))
    counted = found.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("k")).join(
        groups, ["lang", "source"]).withColumn("p", _share("count + 1", "n + v"))
    one = counted.join(other, "lang").filter(apart).select("lang", F.explode(F.array(
        F.struct("source", "item", (F.col("k") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"),
                 (F.col("k") * (_gap("q0", "p") - _gap("q0", "p0"))).alias("value")))).alias("x")).select("lang", "x.*")
    shared = found.filter("sources > 1").join(groups, ["lang", "source"]).select(
        F.xxhash64("lang", "term").alias("tid"), "lang", "term", "source", _share("count + 1", "n + v").alias("p"), "p0")
    both = shared.repartition("tid").sortWithinPartitions("tid").mapInArrow(
        released(_both_sides(side)), "lang string, source string, item string, value long")
    return empty.unionByName(one).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", block: int = BLOCK, merge: int = MERGE, side: int = SIDE,
) -> DataFrame:
    """lang, source, part, item, value, rank; see the module's docstring. `top` limits part `term`."""
    rows = term_frequencies(docs, min_docs, text_col, lang_col, source_col, block, merge)
    langs = rows.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("count").alias("lang_n"))
    groups = rows.groupBy("lang", "source").agg(F.sum("count").alias("n")).join(langs, "lang")
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, _share("1L", "n + v")).otherwise(1)), "groups")
    found = rows.filter("count > 0")
    terms = found.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share("count + 1", "n + v").alias("p"),
        _share("total + 1", "lang_n + v").alias("q")).filter("p > q").select(
        "lang", "source", "item", _gap("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return out(_pair_part(found, groups, side), "pair").unionByName(
        out(terms, "term").filter(F.col("rank") <= top))
