import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from moveproof.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "\\", "\\-", "<", "[",
          "é", "𝄞", " ", "\n", "word", "$1", "|>", "s>", "INST]"]


def escape(text):
    text = text.replace("\\", "\\\\")
    out = ""
    for i, c in enumerate(text):
        out += c
        if any(text.startswith(k, i) for k in chat.CONTROLS):
            out += "\\-"
    return out


def brute(rows, budget, history, cell):
    """Per conversation its windows: (turns repeated, all turns, learned texts)."""
    last = lambda x: 1 << 63 if x is None else x
    by = {}
    for conv, turn, role, text in sorted(
            ((last(c), last(t), r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode())):
        by.setdefault(conv, []).append((role, text, math.ceil(len(text.encode()) / 4) + 4))
    out = {}
    for conv, turns in by.items():
        head = turns[:1] if turns[0][0] == "system" and len(turns) > 1 else []
        turns, room = turns[len(head):], budget - sum(t[2] for t in head)
        starts = [sum(t[2] for t in turns[:i]) for i in range(len(turns))]
        cuts, size = [0], max(cell * budget, history + 1)
        for i, t in enumerate(turns):
            begin = starts[cuts[-1]]
            if i and (starts[i] // size != starts[i - 1] // size
                      or starts[i] + t[2] - begin > (room if begin == 0 else room - history)):
                cuts.append(i)
        windows = []
        for a, b in zip(cuts, [*cuts[1:], len(turns)]):
            back = min(history, room - sum(t[2] for t in turns[a:b]))
            f = a
            while f and starts[a] - starts[f - 1] <= back:
                f -= 1
            windows.append((a - f + (len(head) if a else 0), head + turns[f:b], [t[1] for t in turns[a:b] if t[0] == "assistant"]))
        out[None if conv == 1 << 63 else conv] = windows
    return out


def corpus(seed, n=25):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 9, 40])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "system", "to\\ol\n"])
            text = None if rng.random() < 0.05 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
            rows.append((conv, turn * rng.choice([1, 700]), role, text))
    rows += [(500, 3000 * i, "user" if i % 2 else "assistant", "x" * (i % 90)) for i in range(300)]
    rows += [(600, 0, "user", "long " * 9000), (600, 1, "assistant", "answer"), (601, 0, "system", "alone"),
             (None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (None, 1, None, None), (602, 0, "user", "")]
    return rows + rows[:3]


@pytest.mark.parametrize("budget,history,cell", [(60, 20, 3), (200, 0, 64), (30, 29, 1), (512, 128, 64)])
def test_windows_and_round_trip(spark, budget, history, cell):
    rows = corpus(budget)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    windows = chat.format_windows(df, budget, history, cell)
    wanted = brute(rows, budget, history, cell)
    got = {}
    read = windows.select("id", "start", "n_tokens", "n_repeated", "text", "mask",
                          chat.read_turns(F.col("text")).alias("turns"), chat.read_learned(F.col("text"), F.col("mask")).alias("learned"))
    for r in sorted(read.collect(), key=lambda r: (str(r.id), r.start)):
        got.setdefault(r.id, []).append((r.n_repeated, [tuple(t) for t in r.turns], r.learned))
        body = "".join(f"{chat.START}{escape(a)}{chat.SEPARATOR}{escape(b)}{chat.END}" for a, b in r.turns)
        assert r.text == body
        own = r.turns[r.n_repeated:]
        assert r.n_tokens == sum(math.ceil(len(t.text.encode()) / 4) + 4 for t in r.turns)
        assert r.n_tokens <= budget or len([t for t in own if t is not r.turns[0] or t.role != "system"]) <= 1
    assert got == {c: [(n, [t[:2] for t in turns], learned) for n, turns, learned in w] for c, w in wanted.items()}
    for r in chat.digests(windows).collect():
        turns = [t for n, all_turns, _ in wanted[r.conv_id] for t in all_turns[n:]]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b, _ in turns).encode()).hexdigest()
        learned = "".join(x for _, _, y in wanted[r.conv_id] for x in y)
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_control_string_survives_in_a_text(rows):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(30)) for _ in range(400)]
    out = rows(texts, chat.escaped)
    assert not any(k in t for t in out for k in chat.CONTROLS)
    assert rows(out, chat.unescaped) == texts


def test_edges(spark):
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], SCHEMA)
    for name in ("id", "start", "cell", "tokens", "piece", "system"):
        df = df.withColumn(name, F.lit("clash"))
    r, = chat.format_windows(df.withColumn("mine", F.lit(None).cast("long")), tokens_col="mine").collect()
    assert r.n_tokens == 2 and [tuple(m) for m in r.mask] == [(len("<|im_start|>user<|im_sep|>hi<|im_end|><|im_start|>assistant<|im_sep|>"), 2)]


def test_query_equals_sql(spark, root):
    from compare import difference, duck
    from moveproof.llm.queries import ORACLES, QUERIES

    name = "op12_chat_formatting"
    assert difference(spark, duck(root), QUERIES[name], ORACLES[name], root) is None
    plan = QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
