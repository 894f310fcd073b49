"""Profiles that add up: what a batch says of its columns, kept as small rows that merge.

A state row holds the rows, the missing values, the least and greatest
number and a distinct-count sketch (HyperLogLog with 2**LOG_CELLS cells) of one
column in one batch. States of batches merge into the state of the table in any order and
grouping, so a table's profile needs no second look at its rows. Counts and
ends are exact. A distinct count has a standard error of 1.04 / sqrt(2**LOG_CELLS),
1.6 %, so three in a thousand are off by more than ERROR_BOUND, three times
that; sets of a few hundred values are counted almost exactly.

NaN counts as missing, nested values are compared by content. A batch without
rows gives states without values; a column that a batch lacks has no state there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.functions.rates import share
from moveproof.functions.text import hashable
from moveproof.functions.types import logical_type
from moveproof.operators.profile import union_all

LOG_CELLS = 12
ERROR_BOUND = 3 * 1.04 / 2 ** (LOG_CELLS / 2)
KEYS = ("dataset", "column", "ordinal", "detected_type")
STATE = ("dataset string, column string, ordinal int, detected_type string, total_rows long, filled long, "
         "least double, greatest double, sketch binary")


def column_states(frames: dict[str, DataFrame]) -> DataFrame:
    """State rows of all columns; each table is read once and sends one row per task."""
    parts = []
    for name, df in frames.items():
        values = [hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
        numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema.fields]
        row = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"c{i}") for i, v in enumerate(values)],
            *[F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(LOG_CELLS)).alias(f"h{i}")
              for i, v in enumerate(values)],
            *[end(v.cast("double")).alias(f"{short}{i}") for i, v in enumerate(values) if numeric[i]
              for end, short in ((F.min, "l"), (F.max, "g"))])
        ends = lambda short, i: F.col(f"{short}{i}") if numeric[i] else F.lit(None).cast("double")
        parts.append(row.select(F.inline(F.array(*[F.struct(
            F.lit(name).alias("dataset"), F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
            F.lit(logical_type(f.dataType)).alias("detected_type"), F.col("n").alias("total_rows"),
            F.col(f"c{i}").alias("filled"), ends("l", i).alias("least"), ends("g", i).alias("greatest"),
            F.col(f"h{i}").alias("sketch")) for i, f in enumerate(df.schema.fields)]))))
    return union_all(parts)


def merged_states(states: DataFrame) -> DataFrame:
    """One state per column. A column's place and type are those of its first layout."""
    return states.groupBy("dataset", "column").agg(
        F.min("ordinal").alias("ordinal"), F.min_by("detected_type", "ordinal").alias("detected_type"),
        F.sum("total_rows").alias("total_rows"), F.sum("filled").alias("filled"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("sketch").alias("sketch"))


def state_profile(states: DataFrame, database: str = "source") -> DataFrame:
    """The profile of the merged states, with the layout of `profile.profile_columns` and the ends of numbers."""
    merged = merged_states(states).withColumn("unique_value_count", F.least(
        F.hll_sketch_estimate("sketch"), F.col("filled")))
    nulls = F.col("total_rows") - F.col("filled")
    return merged.select(
        F.lit(database).alias("database"), *KEYS, "total_rows", nulls.alias("null_count"),
        share(nulls, F.col("total_rows")).alias("null_percentage"), F.col("filled").alias("non_null_count"),
        "unique_value_count", share(F.col("unique_value_count"), F.col("filled")).alias("uniqueness_percentage"),
        "least", "greatest")
