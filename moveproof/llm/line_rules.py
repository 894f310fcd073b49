"""Quality rules: per-text measures, and lines that stand in too many documents of a host.

Lines are normalised (A-Z lower-cased, white space runs to one space, ends
trimmed), hashed, and counted per host over documents of distinct text, so
exact copies of one text count once (they are for the near-duplicate stage, which leaves one
of them; counted apart, copies would make each other's lines common). A line is above the limit if more than
`most_documents` documents of the host and more than `most_share` of them, or in any case more than
`most_limit`, have it; it is then removed from all but the first text of that host (the least
hash), so of a group of near copies one document is left whole. A document of which fewer than
`least_words` words or less than `least_share` of its words remain is depleted.

DataFrame functions only. Null text has no words; null ids and hosts are
values like any other; repeated rows get the same result each; an empty table
gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveproof.llm.frames import identified, public_id, stored

# --- fixed values of the base rules ---
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_BASE_WORDS = 10
MOST_REPEAT_PERCENT = 20

MOST_DOCUMENTS = 20
MOST_SHARE = 0.01
MOST_LIMIT = 200
#: Rejected texts up to which they are broadcast; a pair of host and hash each.
BROADCAST_TEXTS = 400_000
LEAST_WORDS = 10
LEAST_SHARE = 0.3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that stand twice or more in one text."""
    def covered(starts):
        return F.aggregate(
            F.transform(starts, lambda p, j: F.least(
                F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window)))),
            F.lit(0), lambda a, b: a + b)

    def of_windows(windows):
        placed = F.sort_array(F.transform(windows, lambda k, p: F.struct(k.alias("k"), p.alias("p"))))
        return let(placed, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, j: (
            F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))), lambda x: x["p"])), covered))

    def of_hashes(h):
        places = F.sequence(F.lit(0), F.size(h) - window)
        each = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + n) for n in range(window)]))
        return let(each, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(of_windows(k)))

    return F.when(F.size(found) < window, 0).otherwise(
        let(F.transform(found, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols, n_dup_lines, n_words and n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    lines = let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return {
        "counted": counted,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": lines.cast("long"),
    }


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE, " "))


def text_lines(docs: DataFrame) -> DataFrame:
    """host, key, line, n, id: a text's distinct normalised lines and the words they hold there.

    Rows of one host and text are folded into one inside each task: `n` adds up
    over them, `id` is the least of their ids.
    """
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), normalised), lambda x: x != "")
    return docs.select("id", "host", "key", F.explode(lines).alias("_line")).select(
        "id", "host", "key", F.xxhash64("_line").alias("line"),
        F.size(F.split("_line", " ")).cast("long").alias("n"),
    ).groupBy("host", "line", "key").agg(F.sum("n").alias("n"), F.min("id").alias("id"))


def common_lines(
    lines: DataFrame, texts: DataFrame, most_documents: int, most_share: float, most_limit: int = MOST_LIMIT
) -> DataFrame:
    """host, line, first: lines above the limits, and the text that keeps them."""
    per_host = texts.groupBy("host").agg(F.count(F.lit(1)).alias("texts")).select(
        F.col("host").alias("_host"), "texts")
    counts = lines.groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("documents"),
        F.min_by("key", F.struct("id", "key")).alias("first"))
    return (
        counts.filter(F.col("documents") > most_documents)
        .join(per_host, F.col("host").eqNullSafe(F.col("_host")))
        .filter(F.col("documents") > F.least(most_share * F.col("texts"), F.lit(float(most_limit))))
        .select(F.col("host").alias("_host"), F.col("line").alias("_line"), "first")
    )


def _removed(
    found: DataFrame, most_documents: int, most_share: float
) -> DataFrame:
    """_host, _key, _removed, _words: words of common lines that texts lose, and all their words; stored."""
    lines = stored(text_lines(found), "lines")  # split once, read for the counts and for the texts
    texts = found.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies"))
    common = common_lines(lines, texts, most_documents, most_share)
    in_text = (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))
    lost = F.when(F.col("key") != F.col("first"), F.col("n")).otherwise(0)
    removed = lines.join(common, in_text, "left").groupBy("host", "key").agg(
        F.sum(lost).alias("n"), F.sum("n").alias("words")).filter("n > 0").alias("r")
    same = F.col("r.host").eqNullSafe(F.col("t.host")) & (F.col("r.key") == F.col("t.key"))
    each = lambda c: (F.col(c) / F.col("copies")).cast("long")
    return stored(removed.join(texts.alias("t"), same).select(
        F.col("r.host").alias("_host"), F.col("r.key").alias("_key"),
        each("n").alias("_removed"), each("words").alias("_words")), "common-lines")


def _failed() -> Column:
    return (F.col("n_words") < LEAST_BASE_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def _depleted(least_words: int, least_share: float) -> Column:
    left = F.col("n_words") - F.col("n_common_words")
    return (left < least_words) | (left < least_share * F.col("n_words"))


def _judged(base: DataFrame, removed: DataFrame, least_words: int, least_share: float) -> DataFrame:
    """Rows of host, key and base measures with n_common_words, base_failed and kept."""
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("key") == F.col("_key"))
    return (
        base.join(removed.drop("_words"), same, "left")
        .withColumn("n_common_words", F.coalesce("_removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", _failed())
        .withColumn("kept", ~F.col("base_failed") & ~_depleted(least_words, least_share))
    )


def quality_rules(
    docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE,
    least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, id_col: str = "doc_id",
    text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """doc_id, key, n_words, the base measures, base_failed, n_common_words, kept; a row per document."""
    found = identified(docs, id_col, text_col, host=host_col)
    measures = base_measures(F.col("text"))
    base = found.select("id", "key", "host", *[c.alias(n) for n, c in measures.items()]).select(
        "id", "key", "host", "counted.*", *[n for n in measures if n != "counted"])
    judged = _judged(base, _removed(found, most_documents, most_share), least_words, least_share)
    return judged.select(
        public_id().alias("doc_id"), "key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "n_common_words")


def kept_documents(
    docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE,
    least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, id_col: str = "doc_id",
    text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """The rows that `quality_rules` keeps, with all their columns.

    Whole documents are not shuffled to be judged: the base rules see one row
    each, depletion follows from the lines, and the depleted texts, as
    host and hash, are held against the documents; up to `BROADCAST_TEXTS` of them are broadcast.
    """
    found = identified(docs, id_col, text_col, host=host_col)
    lost = _removed(found, most_documents, most_share).withColumns(
        {"n_words": F.col("_words"), "n_common_words": F.col("_removed")})
    gone = stored(lost.filter(_depleted(least_words, least_share)).select("_host", "_key"), "depleted")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_TEXTS else gone
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("_text") == F.col("_key"))
    judged = docs.select(row.alias("row"), F.col(f"`{host_col}`").alias("host"),
                         F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_text"))
    judged = judged.join(gone, same, "left_anti").select(
        "row", base_measures(F.col(f"row.`{text_col}`"))["counted"].alias("counted")).select("row", "counted.*")
    return judged.filter(~_failed()).select("row.*")
