r"""Chat formatting: conversations as windows of whole turns under a token budget.

Prefix sums of turn tokens choose the windows: a window takes turns as long as
they fit, and the next one begins with the first turn that does not. The system
turn (a conversation's first turn, if its role is `system` and other turns
follow) stands at the head of every window. Later windows repeat the turns
before them as far as `history` tokens and the budget allow. Only the answers
of a window's own turns are under the loss mask, so a repeated answer is masked
out and each answer is learned once. A turn is never cut: a turn beyond the budget stands in a
window of its own, without history.

Prefix sums are taken in pieces of consecutive turn numbers, and windows are
chosen in cells of `cell` budgets, so a long conversation is spread over many
tasks; a window never crosses a cell's border. A turn that the next cell may
repeat is copied there.

The template is `<|im_start|>` role `<|im_sep|>` text `<|im_end|>`. In roles
and texts a backslash is doubled, and a control string gets `\-` behind its
first character, so none of them can be taken for the template, and `unescaped`
gives every text back.

DataFrame functions only. A turn counts ceil(octets / 4) + 4 tokens, or what
`tokens_col` says (1 if null or less). Null roles and texts count as empty, a
null turn number as the largest, a null conversation id as a conversation of
its own whose id is returned as null. Turns are ordered by number, role and
text; repeated rows are turns of their own. An empty table gives no windows.
Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moveproof.llm.frames import LAST_ID, public_id

# --- fixed values: the template's marks and the control strings of usual templates ---
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (
    START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)

BUDGET = 512
HISTORY = 128
#: Budgets in a cell, whose turns are one row for a while.
CELL = 64
TURN_TOKENS = 4
PIECE_BITS = 10
_TURN = ("start", "end", "role", "text")


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The text without any control string, reversibly."""
    found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), found, r"$0\\-")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Turns with `start` and `end`, the tokens before and up to them, without the system turn, which every row carries."""
    piece = Window.partitionBy("id", "piece").orderBy("turn", "role", "text")
    turns = turns.withColumn("piece", F.shiftright("turn", PIECE_BITS)).withColumn(
        "n", F.row_number().over(piece)).withColumn(
        "upto", F.sum("tokens").over(piece.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("id").orderBy("piece")
    leads = F.when((F.col("n") == 1) & (F.col("role") == "system"), F.struct("text", "tokens"))
    pieces = turns.groupBy("id", "piece").agg(
        F.sum("tokens").alias("_tokens"), F.count(F.lit(1)).alias("_n"), F.max(leads).alias("_first"))
    pieces = pieces.select(
        "id", "piece", F.row_number().over(along).alias("_at"),
        F.coalesce(F.sum("_tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.when(F.sum("_n").over(Window.partitionBy("id")) > 1, F.first("_first").over(along)).alias("system"))
    is_system = (F.col("_at") == 1) & (F.col("n") == 1) & F.col("system").isNotNull()
    end = F.col("_base") + F.col("upto") - F.coalesce("system.tokens", F.lit(0))
    return turns.join(pieces, ["id", "piece"]).filter(~is_system).select(
        "id", "role", "text", F.col("system.text").alias("system"),
        F.coalesce("system.tokens", F.lit(0)).alias("system_tokens"),
        (end - F.col("tokens")).alias("start"), end.alias("end"))


def _window_starts(turns: Column, first: Column, room: Column, history: int) -> Column:
    """Where windows begin: a turn that no longer fits begins the next one."""
    def step(starts: Column, turn: Column) -> Column:
        last = F.element_at(starts, -1)
        full = turn["end"] - last > F.when(last == 0, room).otherwise(room - history)
        return F.when(full & (turn["start"] > last), F.concat(starts, F.array(turn["start"]))).otherwise(starts)

    return F.aggregate(turns, F.array(first), step)


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, cell: int = CELL,
    answers: tuple[str, ...] = ("assistant",), tokens_col: str | None = None,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """id, start, n_tokens, n_repeated, text, mask: a row for each window.

    `start` orders the windows of a conversation, `n_repeated` turns at the
    head are repeats, `mask` lists the (start, length) in code points that are learned.
    """
    long = lambda c: F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(LAST_ID))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tokens = F.ceil(F.octet_length(text) / 4) + TURN_TOKENS if tokens_col is None else F.greatest(
        F.col(f"`{tokens_col}`").cast("long"), F.lit(1))
    turns = _prefix_sums(conversations.select(
        long(id_col).alias("id"), long(turn_col).alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), text.alias("text"),
        tokens.cast("long").alias("tokens")))

    size = max(cell * budget, history + 1)
    home = F.floor(F.col("start") / size)
    tail = (home + 1) * size - F.col("start") <= history
    cells = turns.withColumn("cell", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))))
    cells = cells.groupBy("id", "cell", "system", "system_tokens").agg(
        F.array_sort(F.collect_list(F.struct(*_TURN))).alias("turns"))
    border = F.col("cell") * size
    cells = cells.withColumn("own", F.filter("turns", lambda t: t["start"] >= border)).filter(F.size("own") > 0)
    room = F.lit(budget).cast("long") - F.col("system_tokens")
    cells = cells.withColumn("starts", _window_starts(F.col("own"), F.get("own", F.lit(0))["start"], room, history))

    windows = cells.select("*", F.posexplode("starts").alias("w", "begin")).withColumn(
        "next", F.get("starts", F.col("w") + 1))
    windows = windows.withColumn("mine", F.filter("own", lambda t: (t["start"] >= F.col("begin")) & (
        F.col("next").isNull() | (t["start"] < F.col("next")))))
    taken = F.get("mine", F.size("mine") - 1)["end"] - F.col("begin")
    back = F.least(F.lit(history).cast("long"), room - taken)
    windows = windows.withColumn("before", F.filter("turns", lambda t: (t["start"] < F.col("begin")) & (
        F.col("begin") - t["start"] <= back)))
    repeated = F.col("begin") > 0
    part = lambda role, text, learned: F.struct(
        F.concat(F.lit(START), escaped(role), F.lit(SEPARATOR)).alias("head"), escaped(text).alias("body"),
        learned.alias("learned"))
    parts = F.concat(
        F.when(F.col("system").isNull(), F.array().cast("array<struct<head:string,body:string,learned:boolean>>"))
        .otherwise(F.array(part(F.lit("system"), F.col("system"), F.lit(False)))),
        F.transform("before", lambda t: part(t["role"], t["text"], F.lit(False))),
        F.transform("mine", lambda t: part(t["role"], t["text"], t["role"].isin(*answers))))
    windows = windows.withColumn("parts", parts)

    def spans(so_far: Column, x: Column) -> Column:
        begin = so_far["at"] + F.length(x["head"])
        span = F.struct(begin.alias("start"), F.length(x["body"]).cast("long").alias("length"))
        return F.struct(
            (begin + F.length(x["body"]) + len(END)).alias("at"),
            F.when(x["learned"], F.concat(so_far["mask"], F.array(span))).otherwise(so_far["mask"]).alias("mask"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("mask"))
    whole = F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    return windows.select(
        public_id().alias("id"), F.col("begin").alias("start"),
        (F.col("system_tokens") + taken + F.coalesce(F.col("begin") - F.get("before", F.lit(0))["start"], F.lit(0))
         ).alias("n_tokens"),
        (F.size("before") + (repeated & F.col("system").isNotNull()).cast("int")).alias("n_repeated"),
        F.array_join(whole, "").alias("text"), F.aggregate("parts", none, spans)["mask"].alias("mask"))


def read_turns(text: Column) -> Column:
    """The (role, text) of all turns of a window, from its text alone."""
    parts = F.split(text, re.escape(START))
    body = lambda p: F.substring_index(p, SEPARATOR, -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(
        unescaped(F.substring_index(p, SEPARATOR, 1)).alias("role"),
        unescaped(body(p).substr(F.lit(1), F.length(body(p)) - len(END))).alias("text")))


def read_learned(text: Column, mask: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(mask, lambda m: unescaped(text.substr(
        (m["start"] + 1).cast("int"), m["length"].cast("int"))))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows.

    A digest is of one conversation's whole text, which meets in one row; the windows do not.
    """
    own = F.slice("turns", F.col("n_repeated") + 1, F.size("turns"))
    spoken = F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = windows.withColumn("turns", read_turns(F.col("text"))).withColumn("own", own).select(
        "id", "start", F.size("own").alias("n"), F.length("text").alias("chars"),
        F.array_join(spoken, "").alias("spoken"),
        F.array_join(read_learned(F.col("text"), F.col("mask")), "").alias("learned"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("start", c))), lambda x: x[c]), "")
    return read.groupBy("id").agg(
        F.sum("n").alias("n_turns"), F.sha2(joined("spoken"), 256).alias("turns_sha256"),
        F.sum(F.length("learned")).alias("loss_chars"), F.sha2(joined("learned"), 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars")).withColumnRenamed("id", "conv_id")
