"""Relationship discovery: which columns' values all, or nearly all, occur in another column.

Every column is read once. Values are folded to (value, column) with a count
inside each task, so a value held by a third of the rows costs one row per
task; then each value becomes the bitset of the columns that have it, and equal
bitsets become one row with the number of values they stand for. Whatever is
asked of pairs of columns is answered from those bitsets, without any join of
columns with columns.

Whole numbers, texts, days and times are compared among themselves; decimals
without places count as whole numbers, text of 64 octets or more is compared by
its SHA-256. Reals, booleans and nested values are no keys and take no part.
Nulls are no values. A column without values is included in everything and is
not reported.

The same sets tell which vanished column came back under another name.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.functions.rates import share
from moveproof.functions.text import comparable, compact
from moveproof.operators.profile import union_all
from moveproof.session import literal_rows, stored

#: Columns in one word of a bitset.
WORD = 62


def key_value(col: Column, dtype: T.DataType) -> tuple[str, Column] | None:
    """Family and comparable value of a key-like column, None for others."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole", col.cast("long")
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0 and dtype.precision <= 18:
        return "whole", col.cast("long")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text", compact(col)
    if isinstance(dtype, T.DateType):
        return "day", F.unix_date(col).cast("long")
    if isinstance(dtype, T.TimestampType):
        return "time", F.unix_micros(col)
    if isinstance(dtype, T.TimestampNTZType):
        return "time", F.unix_micros(col.cast("timestamp"))
    return None


def _bits(name: str, ids: list[int]) -> Column:
    """The column numbers whose bits are set."""
    return F.array_compact(F.array(*[
        F.when(F.shiftright(f"{name}{i // WORD}", i % WORD).bitwiseAND(F.lit(1)) == 1, F.lit(i)) for i in ids]))


def any_value(col: Column, dtype: T.DataType) -> tuple[str, Column]:
    """Like `key_value`, with reals, booleans and nested values as families of their own."""
    if (found := key_value(col, dtype)) is not None:
        return found
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real", comparable(col.cast("double"), T.DoubleType()).cast("string")
    return dtype.simpleString(), comparable(col, dtype).cast("string")


def column_sets(
    frames: dict[str, DataFrame], value_of: Callable[[Column, T.DataType], tuple[str, Column] | None] = key_value,
) -> tuple[list[tuple[int, str, str]], DataFrame]:
    """The key-like columns, numbered, and the bitsets of columns that values have, stored.

    A row of the sets says that `n_values` values occur in the columns of `has`, and
    more than once in those of `many`; both are words of WORD columns.
    """
    columns: list[tuple[int, str, str]] = []
    cells: dict[str, list[DataFrame]] = {}
    of_family: dict[str, list[int]] = {}
    for name, df in frames.items():
        found: dict[str, list[Column]] = {}
        for f in df.schema.fields:
            if (valued := value_of(F.col(f"`{f.name}`"), f.dataType)) is None:
                continue
            family, value = valued
            found.setdefault(family, []).append(F.struct(F.lit(len(columns)).alias("id"), value.alias("value")))
            of_family.setdefault(family, []).append(len(columns))
            columns.append((len(columns), name, f.name))
        for family, structs in found.items():
            cells.setdefault(family, []).append(df.select(F.inline(F.array(*structs))))
    if not columns:
        raise ValueError("no table has a column that could be a key")
    words = range(len(columns) // WORD + 1)

    def word(w: int, when: Column) -> Column:
        here = (F.floor(F.col("id") / WORD) == w) & when
        return F.coalesce(F.bit_or(F.when(here, F.expr(f"shiftleft(1L, id % {WORD})"))), F.lit(0).cast("long"))

    def sets(parts: list[DataFrame]) -> DataFrame:
        counted = union_all(parts).filter(F.col("value").isNotNull()).groupBy("value", "id").agg(
            F.count(F.lit(1)).alias("copies"))
        folded = counted.groupBy("value").agg(
            *[word(w, F.lit(True)).alias(f"has{w}") for w in words],
            *[word(w, F.col("copies") > 1).alias(f"many{w}") for w in words])
        return folded.groupBy(*[f"{kind}{w}" for kind in ("has", "many") for w in words]).agg(
            F.count(F.lit(1)).alias("n_values"))

    return columns, stored(union_all(sets(parts) for parts in cells.values()), "column-sets")


def inclusions(frames: dict[str, DataFrame], min_share: float = 1.0, min_values: int = 1) -> DataFrame:
    """Pairs of columns of which the child's distinct values occur in the parent, at least `min_share` of them.

    Columns: child, child_key, parent, parent_key, child_values, shared_values,
    parent_values, share (per cent), parent_unique (no value of the parent repeats).
    With `min_share` 1 a child's bitsets are intersected, and pairs that do not
    hold never become rows; else the values of each pair are added up.
    """
    spark = next(iter(frames.values())).sparkSession
    columns, sets = column_sets(frames)
    ids = [i for i, _, _ in columns]
    words = range(len(columns) // WORD + 1)
    own = sets.select("*", F.explode(_bits("has", ids)).alias("i"))
    of_own = F.exists(_bits("many", ids), lambda x: x == F.col("i"))
    totals = own.groupBy("i").agg(
        F.sum("n_values").alias("n"), (F.sum(of_own.cast("long")) == 0).alias("is_unique"),
        *[F.bit_and(f"has{w}").alias(f"has{w}") for w in words])
    if min_share >= 1:
        pairs = totals.select("i", F.explode(_bits("has", ids)).alias("j"), F.col("n").alias("shared_values"))
    else:
        pairs = own.select("i", F.explode(_bits("has", ids)).alias("j"), "n_values").groupBy("i", "j").agg(
            F.sum("n_values").alias("shared_values"))
    names = literal_rows(spark, "id int, dataset string, column string", columns)
    side = lambda key, table, column: names.select(
        F.col("id").alias(key), F.col("dataset").alias(table), F.col("column").alias(column))
    child = totals.select("i", F.col("n").alias("child_values"))
    parent = totals.select(F.col("i").alias("j"), F.col("n").alias("parent_values"), F.col("is_unique").alias("parent_unique"))
    return (
        pairs.filter("i <> j").join(child, "i").join(parent, "j")
        .filter((F.col("shared_values") * 10_000 >= F.col("child_values") * round(min_share * 10_000))
                & (F.col("child_values") >= min_values))
        .join(side("i", "child", "child_key"), "i").join(side("j", "parent", "parent_key"), "j")
        .select("child", "child_key", "parent", "parent_key", "child_values", "shared_values", "parent_values",
                share(F.col("shared_values"), F.col("child_values")).alias("share"), "parent_unique")
    )


def relationships(frames: dict[str, DataFrame], min_share: float = 0.9, min_values: int = 2) -> DataFrame:
    """Inclusions in a column without repeats, candidates for foreign keys; `rank` 1 has the smallest parent."""
    order = Window.partitionBy("child", "child_key").orderBy(
        F.desc("shared_values"), "parent_values", "parent", "parent_key")
    return inclusions(frames, min_share, min_values).filter("parent_unique").withColumn(
        "rank", F.row_number().over(order))


def renamed_columns(
    before: dict[str, DataFrame], after: dict[str, DataFrame], min_similarity: float = 0.5,
) -> list[tuple[str, str, str, int, int, int]]:
    """Columns that vanished from a table and came back under another name, by the values they hold.

    Names are compared without case. Of each table only the columns that vanished
    or appeared are read. Two of them are alike by shared / all distinct values;
    the most alike pair is taken first, of equals the one whose old column, then
    whose new column, stands first in its table, and no column is taken twice.
    Rows: (table, old, new, shared, old_values, new_values); a column without values matches none.
    """
    frames, order = {}, {}
    for name in sorted(set(before) & set(after)):
        sides = {"old": before[name], "new": after[name]}
        folded = {k: {c.strip().lower() for c in df.columns} for k, df in sides.items()}
        for side, other in (("old", "new"), ("new", "old")):
            own = [c for c in sides[side].columns if c.strip().lower() not in folded[other]]
            order |= {(name, side, c): i for i, c in enumerate(own)}
            if own:
                frames[f"{side}:{name}"] = sides[side].select(*[F.col(f"`{c}`") for c in own])
    if not frames:
        return []
    columns, sets = column_sets(frames, any_value)
    ids = [i for i, _, _ in columns]
    own = sets.select(F.explode(_bits("has", ids)).alias("i"), _bits("has", ids).alias("ids"), "n_values")
    counts = own.select("i", F.explode("ids").alias("j"), "n_values").groupBy("i", "j").agg(
        F.sum("n_values").alias("n")).collect()  # one row per pair of changed columns
    shared = {(r["i"], r["j"]): r["n"] for r in counts}
    pairs = []
    for (i, j), n in shared.items():
        (_, left, old), (_, right, new) = columns[i], columns[j]
        if left.startswith("old:") and right == f"new:{left[4:]}":
            table, a, b = left[4:], shared[i, i], shared[j, j]
            if n >= min_similarity * (a + b - n):
                rank = (-Fraction(n, a + b - n), order[table, "old", old], order[table, "new", new])
                pairs.append((table, rank, old, new, n, a, b))
    taken, out = set(), []
    for table, _, old, new, n, a, b in sorted(pairs):
        if not {(table, "old", old), (table, "new", new)} & taken:
            taken |= {(table, "old", old), (table, "new", new)}
            out.append((table, old, new, n, a, b))
    return out


def as_relations(found: DataFrame, frames: dict[str, DataFrame]) -> list[dict]:
    """Discovered pairs in the form `keys.fk_orphans` takes; at most one for each pair of columns."""
    return [{
        "name": f"{r.child}.{r.child_key} -> {r.parent}.{r.parent_key}", "child_name": r.child,
        "child": frames[r.child], "child_key": r.child_key, "parent": frames[r.parent], "parent_key": r.parent_key,
    } for r in found.orderBy("child", "child_key", "parent", "parent_key").collect()]
