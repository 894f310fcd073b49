"""Writes that measure what they write, in the same job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.functions.text import is_missing


def measured_write(
    df: DataFrame, path: str, measures: dict[str, Column], mode: str = "overwrite", partition_by: tuple[str, ...] = ()
) -> dict:
    """Write parquet and return the aggregates `measures` of the written rows.

    They are gathered by the tasks that write, so nothing is read again. A task
    that is run again counts once. The values are those of an aggregate without groups.
    """
    observed = Observation()
    writer = df.observe(observed, *[c.alias(n) for n, c in measures.items()]).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return observed.get


def table_measures(schema: T.StructType, checks: dict[str, Column] | None = None) -> dict[str, Column]:
    """Rows, nulls of each column, and the rows that fail each named check (false or null)."""
    out = {"rows": F.count(F.lit(1))}
    for f in schema.fields:
        out[f"nulls:{f.name}"] = F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType))
    for name, check in (checks or {}).items():
        out[f"failed:{name}"] = F.count_if(~F.coalesce(check, F.lit(False)))
    return out
