"""Load-side reshaping: map, align, evolve, stamp, sample, retain, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moveproof.functions.names import NameCollision, column_target, strip, suffixed
from moveproof.functions.types import cast_to
from moveproof.operators.profile import union_all
from moveproof.operators.ranking import numbered
from moveproof.session import literal_rows


class StrictSchemaError(ValueError):
    """A load would have to create a table or column under a strict schema."""


def mapped_names(df: DataFrame, **mapping) -> dict[str, str]:
    """Source to target column names of one table; ignored columns are left out.

    Only the column names (schema-sized) are evaluated, with the same
    expression that maps names held as data.
    """
    names = literal_rows(df.sparkSession, "ordinal int, name string", list(enumerate(df.columns)))
    rows = names.select("ordinal", "name", column_target(F.col("name"), **mapping).alias("t"))
    found = {r["name"]: r["t"] for r in rows.orderBy("ordinal").collect() if r["t"] is not None}
    if len(set(found.values())) < len(found):
        repeated = sorted({t for t in found.values() if list(found.values()).count(t) > 1})
        raise NameCollision(f"several source columns map to {repeated}")
    return found


def map_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in names.items()])


def renamed_by_style(df: DataFrame, targets: list[str], strategy: str = "suffix") -> DataFrame:
    return df.toDF(*suffixed(targets, strategy))


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns in first-seen order, absent ones null."""
    return union_all(frames)


def align_to(df: DataFrame, target: list[tuple[str, str]]) -> DataFrame:
    """Target columns the data has, in target order, then the others as null."""
    have = [F.col(f"`{n}`").cast(t).alias(n) for n, t in target if n in df.columns]
    lack = [F.lit(None).cast(t).alias(n) for n, t in target if n not in df.columns]
    return df.select(*have, *lack)


def evolve(stored: DataFrame | None, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """Stored rows plus incoming rows under the additive union of both schemas.

    `strict` refuses a table that does not exist and columns it does not have.
    """
    if stored is None:
        if strict:
            raise StrictSchemaError("the table does not exist")
        return incoming
    unknown = [c for c in incoming.columns if c not in stored.columns]
    if unknown and strict:
        raise StrictSchemaError(f"columns not in the table: {unknown}")
    return stored.unionByName(incoming, allowMissingColumns=True)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as their logical types; a value that does not fit becomes null."""
    return df.select(*[
        (cast_to(F.col(f"`{c}`"), types[c]) if c in types else F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ])


def sample_view(df: DataFrame, order: list[str], rows: int = 10) -> DataFrame:
    """The sample a generated view shows: the first rows in key order."""
    return df.orderBy(*order).limit(rows)


def stamped(df: DataFrame, ts: Column, column: str = "created_at", keep: bool = False) -> DataFrame:
    """Insert time set on load; `keep` leaves times that are already there.

    A table without the column is returned unchanged, as a load skips it.
    """
    if column not in df.columns:
        return df
    return df.withColumn(column, F.coalesce(F.col(column), ts) if keep else ts)


def retention_label(ts: Column, days: int, archive: bool, as_of: Column) -> Column:
    """KEEP inside the retention period; beyond it ARCHIVE if archiving is required, else PURGE."""
    return F.when(ts >= as_of - F.make_dt_interval(F.lit(days)), "KEEP").otherwise(
        "ARCHIVE" if archive else "PURGE"
    )


def quarantine(df: DataFrame, types: dict[str, str], required: list[str] = ()) -> DataFrame:
    """Every row with an `error`: null for good rows, else the columns that fail.

    A value fails when it is filled but does not fit its type, or is blank
    where it is required. One pass; split with `error is null`.
    """
    problems = []
    for c, logical in types.items():
        value = F.col(f"`{c}`")
        filled = strip(value) != ""
        problems.append(
            F.when(filled & cast_to(value, logical).isNull(), f"{c}: not {logical}")
        )
    for c in required:
        problems.append(F.when(F.coalesce(strip(F.col(f"`{c}`")), F.lit("")) == "",
                               f"{c}: missing"))
    text = F.concat_ws("; ", *problems)
    return df.withColumn("error", F.when(text != "", text))


def resolve_collisions(names: DataFrame, chunk_width: int = 10_000) -> DataFrame:
    """Repeated targets (table, ordinal, target) numbered in arrival order, no name given twice.

    The first arrival keeps its target, the others get x_2, x_3 and so on,
    leaving out numbered names that are a target of the table themselves. Names
    numbered from different targets cannot meet, so this settles all of them.
    Arrival positions are cut into ranges, so a target that most rows share is
    numbered by many tasks. `is_moved` marks names that left out a number.
    """
    chunked = names.withColumn("chunk", F.floor(F.col("ordinal") / chunk_width))
    ranked = numbered(chunked, ["table", "target"], ["chunk"], ["ordinal"], "arrival").drop("chunk")
    natural = names.select("table", "target").distinct()
    parts = F.regexp_extract("target", r"^(.*)_([1-9][0-9]{0,17})$", 1)
    number = F.regexp_extract("target", r"^(.*)_([1-9][0-9]{0,17})$", 2).try_cast("long")
    taken = natural.select("table", parts.alias("target"), number.alias("number")).filter("number > 1")
    # the j-th taken number, less the j - 1 before it, moves every arrival at or above it by one
    taken = taken.groupBy("table", "target").agg(F.array_sort(F.collect_list("number")).alias("taken"))
    moves = F.transform("taken", lambda n, j: n - j)
    moved = F.coalesce(F.size(F.filter(moves, lambda n: n <= F.col("arrival"))), F.lit(0))
    placed = ranked.join(taken, ["table", "target"], "left").withColumn(
        "number", F.col("arrival") + F.when(F.col("arrival") > 1, F.greatest(moved, F.lit(0))).otherwise(0))
    return placed.withColumn(
        "final_name",
        F.when(F.col("arrival") == 1, F.col("target"))
        .otherwise(F.concat_ws("_", "target", F.col("number").cast("string"))),
    ).withColumn("is_moved", F.col("number") > F.col("arrival")).drop("taken", "number")


def empty_names(names: DataFrame, target: str) -> DataFrame:
    """Findings for names of which clean-up leaves nothing."""
    return names.filter(F.col(target).isNull()).withColumns(
        {"issue_type": F.lit("EMPTY_NAME"), "severity": F.lit("HIGH")})


def target_collisions(names: DataFrame) -> DataFrame:
    """Targets that several sources of one table map to: (table, target, sources)."""
    return (
        names.groupBy("table", "target").agg(F.count_distinct("name").alias("sources"))
        .filter(F.col("sources") > 1)
    )
