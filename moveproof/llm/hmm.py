"""LM scoring: a hidden Markov model over word classes on top of exact word counts.

Tokens are the words of the text (A-Z lower-cased) and one end token. The base
probability of a token is (c + 0.5) / (N + 0.5 (V + 1)), with c its count, N
all and V the distinct tokens of the training documents; an unseen word has
c = 0. The model keeps the base distribution inside a class of words and lets a
hidden state choose the class: P(w | state) = P(class | state) * base(w) / base(class).
Each of the `HEAD_CLASSES` most frequent words is a class, rarer words share
`TAIL_CLASSES` classes by their last letters, so the state table is bounded
while the word counts are exact and grow with the corpus. An unseen word counts
as a token of its class, so the probabilities of all tokens add up to one or less.

Baum-Welch: every task runs the scaled forward and backward recursions over its
training documents (in pieces of `SEGMENT` tokens) and sends expected counts, a
table of states by classes; these are added per state, and the driver turns
them into the next parameters. A score is the exact scaled forward
recursion over a whole document.

Word counts and texts meet in a join by word. Words among the `HEAD` most
frequent are counted against a broadcast table of that size, so no frequent word
is a join key.

Words are told apart by 64-bit hashes. Null text is empty (one end token); a
null id counts as training; repeated rows are scored each; with no training
document every token has the same base probability. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveproof.llm import sketch, words as W
from moveproof.llm.frames import released, send_code, stored

HEAD = 1 << 18
HEAD_CLASSES = 1 << 14
TAIL_BITS = 12
STATES = 8
ROUNDS = 7
SEGMENT = 256
TOGETHER = 1024
SMOOTH = 200.0
FLUSH = 1 << 20

TAIL = np.uint64((1 << TAIL_BITS) - 1)
END = np.uint64(0x5EED0E4D00000000)

ENCODED = ("ref long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
           "classes binary, tail array<long>")


def token_keys(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's words and then its end, and the number of each text's.

    The low bits of a word's key tell its tail class, a hash of its last three bytes.
    """
    texts = W.Texts(W.LOWER[texts.data], texts.bounds)
    found = W.words_of(texts)
    hashes = W.word_hashes(texts, found)
    ending = W.span_hashes(texts.data, np.maximum(found.starts, found.ends - 3), found.ends)
    count = np.diff(found.bounds)
    keys = np.full(len(hashes) + len(count), END, np.uint64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(count)), count)
    keys[place] = (hashes & ~TAIL) | (ending & TAIL)
    return keys, count + 1


def _counted(batches):
    """Distinct keys of a task's tokens and their counts."""
    held, size = [], 0

    def folded():
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    def batch(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    for _, texts in W.sliced(batches):
        held.append(np.unique(token_keys(texts)[0], return_counts=True))
        size += len(held[-1][0])
        if size > 2 * FLUSH:
            held = [folded()]
            size = len(held[0][0])
            if size > FLUSH:
                yield batch(*held[0])
                held, size = [], 0
    if held:
        yield batch(*folded())


def word_counts(docs: DataFrame) -> DataFrame:
    """key, n: how often each token stands in the documents."""
    return docs.select("text").mapInArrow(released(_counted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Totals, and counts and classes of the most frequent tokens."""

    def __init__(self, total: int, distinct: int, keys: np.ndarray, counts: np.ndarray, tails: np.ndarray):
        self.total, self.distinct = total, distinct
        self.space = total + 0.5 * (distinct + 1)
        rank = np.arange(len(keys))
        classes = np.where(rank < HEAD_CLASSES, rank, HEAD_CLASSES + (keys & TAIL).astype(np.int64))
        order = np.argsort(keys)
        self.keys, self.counts, self.classes = keys[order], counts[order], classes[order].astype(np.uint16)
        # base probability of each class; a tail class also holds its unseen words
        own = np.bincount(classes, counts + 0.5, minlength=HEAD_CLASSES + len(tails))
        own[HEAD_CLASSES:] = tails + 0.5
        heads = keys[:HEAD_CLASSES]
        np.subtract.at(own, HEAD_CLASSES + (heads & TAIL).astype(np.int64), counts[:HEAD_CLASSES] + 0.5)
        self.base = np.maximum(own, 0.5) / self.space

    def log_base(self, counts):
        return np.log10((counts + 0.5) / self.space)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    found = counts.agg(F.sum("n"), F.count("n")).first()
    tail = F.col("key").bitwiseAND(F.lit(int(TAIL)))
    tails = np.zeros(1 << TAIL_BITS)
    for row in counts.groupBy(tail.alias("c")).agg(F.sum(F.col("n") + 0.5).alias("n")).collect():
        tails[row["c"]] = row["n"]
    top = counts.orderBy(F.desc("n"), "key").limit(head).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    return Vocabulary(found[0] or 0, found[1], keys, top.column("n").to_numpy(), tails)


def _encoded(known):
    def rows(batches):
        ref = TaskContext.get().partitionId() << 40
        words = known.value
        log_base = words.log_base(words.counts)
        for batch, texts in W.sliced(batches):
            keys, n = token_keys(texts)
            of = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(words.keys, keys), max(len(words.keys) - 1, 0))
            hit = words.keys[at] == keys if len(words.keys) else np.zeros(len(keys), bool)
            classes = (HEAD_CLASSES + (keys & TAIL)).astype(np.uint16)
            classes[hit] = words.classes[at[hit]]
            base = np.bincount(of[hit], log_base[at[hit]], minlength=len(n)).astype(float)
            missed = np.bincount(of[~hit], minlength=len(n))
            offsets = np.concatenate([[0], np.cumsum(missed)]).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[~hit].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(ref, ref + len(n))), batch.column("doc_id"), batch.column("held_out"),
                 pa.array(n), pa.array(n - missed), pa.array(base), W.binary(classes, n), tail],
                ["ref", "doc_id", "held_out", "n_tokens", "n_known", "base", "classes", "tail"])
            ref += len(n)
    return rows


class Model:
    """start[k], move[j, k] and emit[class, k], the probability of a class in state k."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, base: np.ndarray, states: int) -> "Model":
        """States that stay and prefer classes at random, the same at every run."""
        rng = np.random.default_rng(20)
        emit = base[:, None] * np.exp(rng.normal(0, 1, (len(base), states)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def fitted(cls, base, start, move, emit) -> "Model":
        emit = emit + SMOOTH * base[:, None]
        move = move + 1
        start = start + 1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def segments(classes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of pieces of at most `size` tokens, longest first."""
    ends = np.cumsum(lengths)
    pieces = -(-lengths // size)
    start = np.repeat(ends - lengths, pieces) + size * W.ranges(np.zeros(len(pieces), np.int64), pieces)
    length = np.minimum(size, np.repeat(ends, pieces) - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def expected_counts(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Expected starts, moves and emissions of some pieces (longest first), by forward-backward."""
    states, steps, n = len(model.start), int(length[0]), len(start)
    active = np.searchsorted(-length, -np.arange(steps), "left")  # pieces longer than t
    symbols = [classes[start[:active[t]] + t] for t in range(steps)]
    seen = [model.emit[s] for s in symbols]
    alpha, scale = [], []
    now = model.start * seen[0]
    for t in range(steps):
        if t:
            now = (alpha[-1][:active[t]] @ model.move) * seen[t]
        total = now.sum(1, keepdims=True)
        now = now / total
        alpha.append(now)
        scale.append(total)
    move = np.zeros((states, states))
    beta = np.ones((active[-1], states))
    gammas = [None] * steps
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            ahead = seen[t + 1] * beta / scale[t + 1]
            move += alpha[t][:active[t + 1]].T @ ahead
            beta = np.concatenate([ahead @ model.move.T, np.ones((active[t] - active[t + 1], states))])
        gammas[t] = alpha[t] * beta
    gamma, symbol = np.concatenate(gammas), np.concatenate(symbols)
    emit = np.stack([np.bincount(symbol, gamma[:, k], minlength=len(model.emit)) for k in range(states)])
    return gammas[0].sum(0), move * model.move, emit


def _expected(known):
    """One row per state: expected starts, moves and emissions over a task's documents."""
    def rows(batches):
        model = known.value
        states = len(model.start)
        total = np.zeros((states, 1 + states + len(model.emit)))
        any_ = False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_ = True
            classes, lengths = W.flat(batch.column("classes"), np.uint16)
            start, length = segments(classes, lengths, SEGMENT)
            for at in range(0, len(start), TOGETHER):
                begin, move, emit = expected_counts(
                    model, classes, start[at:at + TOGETHER], length[at:at + TOGETHER])
                total += np.concatenate([begin[:, None], move, emit], 1)
        if any_:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(states), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in total])],
                ["state", "counts"])
    return rows


def _added(table):
    total = sum(np.frombuffer(c.as_buffer(), "<f8") for c in table.column("counts"))
    return pa.table({"state": table.column("state")[:1], "counts": pa.array([total.tobytes()])})


def baum_welch(encoded: DataFrame, base: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """The model after some rounds over all rows of `encoded` (classes)."""
    context = encoded.sparkSession.sparkContext
    model = Model.first(base, states)
    for _ in range(rounds):
        known = context.broadcast(model)
        layout = "state int, counts binary"
        partial = encoded.select("classes").mapInArrow(released(_expected(known)), layout)
        sums = sketch.folded(partial, "state", _added, layout).collect()
        if not sums:
            return model
        table = np.stack([np.frombuffer(r["counts"]) for r in sorted(sums)])
        model = Model.fitted(base, table[:, 0], table[:, 1:1 + states], table[:, 1 + states:].T)
        known.unpersist()
    return model


def log10_ratio(start, move, ratio, classes, lengths) -> np.ndarray:
    """log10 of each sequence's likelihood with emissions `ratio`, by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out = np.zeros(len(lengths))
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    now = None
    for t in range(steps):
        seen = ratio[classes[begin[:active[t]] + t]]
        now = start * seen if now is None else (now[:active[t]] @ move) * seen
        total = now.sum(1)
        now /= total[:, None]
        out[:active[t]] += np.log10(total)
    result = np.empty(len(out))
    result[order] = out
    return result


def _scored(known):
    def rows(batches):
        start, move, ratio = known.value
        for batch in batches:
            if batch.num_rows:
                classes, lengths = W.flat(batch.column("classes"), np.uint16)
                gain = log10_ratio(start, move, ratio, classes, lengths)
                names = ["ref", "doc_id", "held_out", "n_tokens", "n_known", "base"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names] + [pa.array(gain)], [*names, "gain"])
    return rows


def hmm_scores(
    docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    `held_out` marks the rows that nothing is learned from.
    """
    send_code(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    found = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = stored(word_counts(found.filter(~F.col("held_out"))), "word-counts")
    words = vocabulary(counts, head)
    encoded = stored(found.mapInArrow(released(_encoded(context.broadcast(words))), ENCODED), "classes")
    model = baum_welch(encoded.filter(~F.col("held_out")), words.base, states, rounds)
    ratio = model.emit / words.base[:, None]
    parts = encoded.select("ref", "doc_id", "held_out", "n_tokens", "n_known", "base", "classes").mapInArrow(
        released(_scored(context.broadcast((model.start, model.move, ratio)))),
        "ref long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double")
    n = F.coalesce("n", F.lit(0))
    tail = (
        encoded.select("ref", F.explode("tail").alias("key")).join(counts, "key", "left")
        .groupBy("ref").agg(F.sum(F.log10((n + 0.5) / F.lit(float(words.space)))).alias("_tail"),
                            F.count("n").alias("_known"))
    )
    base = F.col("base") + F.coalesce("_tail", F.lit(0.0))
    return parts.join(tail, "ref", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"), base.alias("base_score"),
        (base + F.col("gain")).alias("score"))
