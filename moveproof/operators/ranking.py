"""Row numbers within groups that do not need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(
    df: DataFrame, group: list[str], chunk: list[str], order: list[str], into: str = "rank"
) -> DataFrame:
    """row_number over (partition by group order by chunk, order), computed in chunks.

    `chunk` columns are deterministic and lead the order, so a group is cut
    into ordered pieces: rows are numbered inside (group, chunk), and the
    sizes of the earlier pieces are added. Only those sizes, one row per piece,
    meet per group.
    """
    keys = [*group, *chunk]
    before = Window.partitionBy(*group).orderBy(*chunk).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(into, (F.col("_inside") + F.col("_offset")).cast("long"))
        .drop("_inside", "_offset")
    )


def change_numbered(
    df: DataFrame, group: str, chunk: str, order: list[str], state: str, into: str = "version"
) -> DataFrame:
    """Running number of distinct consecutive states per group, starting at 1.

    A row differs when its state is not the state of the row before it. Inside
    a (group, chunk) piece that is a lag; across pieces only each piece's
    first state, last state and number of changes are compared.
    """
    piece = Window.partitionBy(group, chunk).orderBy(*order)
    marked = df.withColumn("_row", F.row_number().over(piece)).withColumn(
        "_changed",
        F.when(F.col("_row") == 1, 0)
        .when(F.col(state).eqNullSafe(F.lag(state).over(piece)), 0).otherwise(1),
    ).withColumn("_inside", F.sum("_changed").over(
        piece.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy(group, chunk).agg(
        F.min_by(state, "_row").alias("_first"), F.max_by(state, "_row").alias("_last"),
        F.sum("_changed").alias("_n"),
    )
    along = Window.partitionBy(group).orderBy(chunk)
    opened = F.when(F.row_number().over(along) == 1, 1).when(
        F.col("_first").eqNullSafe(F.lag("_last").over(along)), 0
    ).otherwise(1)
    running = F.sum(F.col("_open") + F.col("_n")).over(
        along.rowsBetween(Window.unboundedPreceding, 0)
    )
    bases = pieces.withColumn("_open", opened).select(
        group, chunk, "_open", (running - F.col("_n")).alias("_base")
    )
    return (
        marked.join(bases, [group, chunk])
        .withColumn(into, (F.col("_base") + F.col("_inside")).cast("long"))
        .withColumn("is_new_version", F.when(F.col("_row") == 1, F.col("_open") == 1)
                    .otherwise(F.col("_changed") == 1))
        .drop("_row", "_changed", "_inside", "_base", "_open")
    )
