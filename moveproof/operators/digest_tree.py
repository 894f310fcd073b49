"""Digest trees: find the rows in which two large snapshots differ without reading the rest.

A row belongs to the leaf named by the first 16 bits of the MD5 of its key's
text. A leaf's digest is its number of rows and the sums of the four quarters of
its rows' MD5s, so order does not matter and repeats count; an inner node sums
its 16 children. A snapshot is written as folders of leaf ranges, sorted by
leaf, next to its tree. Two snapshots are compared from the root down: below
equal nodes nothing is read, and of the rows only the folders and leaves that
differ, keys and row digests alone.

Any engine that has MD5 can compute the same tree, so the two sides need not be
in one system. Values are taken as text with their length in front, nulls as
"~", columns in name order, nested values as canonical JSON; a column that one
side lacks makes its rows differ. A sum holds 2**31 rows of one leaf. Rows with
a null key are a leaf's rows like others. A key held by a third of the rows is
one leaf, whose rows are written by several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.functions.text import canonical_json
from moveproof.operators.snapshot import change_status
from moveproof.session import literal_rows

LEAF_BITS, FAN_BITS, FOLDER_BITS = 16, 4, 6
LEVELS = LEAF_BITS // FAN_BITS
SUMS = [f"s{i}" for i in range(4)]
_PARTS = [f"_d{i}" for i in range(4)]


def value_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        col = canonical_json(col, dtype)
    elif isinstance(dtype, T.VariantType):
        col = F.to_json(col)
    elif isinstance(dtype, T.BinaryType):
        col = F.hex(col)
    text = col.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def _digest(df: DataFrame, columns: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.md5(F.concat_ws("|", *[value_text(F.col(f"`{c}`"), types[c]) for c in columns]))


def _hex(digest: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `_leaf`, the quarters of their digest, and `_folder`."""
    row = _digest(df, sorted(df.columns))
    leaf = _hex(_digest(df, keys), 1, LEAF_BITS // 4).cast("int")
    df = df.withColumns({"_leaf": leaf, "_row": row})
    return df.withColumns({
        **{p: _hex(F.col("_row"), 8 * i + 1, 8) for i, p in enumerate(_PARTS)},
        "_folder": F.shiftright("_leaf", LEAF_BITS - FOLDER_BITS)}).drop("_row")


def _tree(placed: DataFrame) -> DataFrame:
    """level, node, n_rows, s0 to s3 from rows with leaf and digest; level 0 is the root."""
    leaves = placed.groupBy("_leaf").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(p).alias(s) for p, s in zip(_PARTS, SUMS)])
    above = F.array(*[
        F.struct(F.lit(level).alias("level"), F.shiftright("_leaf", LEAF_BITS - FAN_BITS * level).alias("node"))
        for level in range(LEVELS + 1)])
    return leaves.select(F.inline(above), "n_rows", *SUMS).groupBy("level", "node").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", *SUMS)])


def digest_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    return _tree(_placed(df, keys))


def write_snapshot(df: DataFrame, keys: list[str], path: str) -> None:
    """Rows below `path`/rows by folders of leaf ranges, and last the tree below `path`/tree."""
    placed = _placed(df, keys).repartitionByRange("_leaf", "_d0").sortWithinPartitions("_folder", "_leaf")
    placed.write.mode("overwrite").partitionBy("_folder").parquet(f"{path}/rows")
    schema = T.StructType(df.select(*keys).schema.fields + placed.select("_leaf", *_PARTS).schema.fields)
    tree = _tree(df.sparkSession.read.schema(schema).parquet(f"{path}/rows"))
    tree.coalesce(1).write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")


_NODE = "node int, n_rows long, s0 long, s1 long, s2 long, s3 long, level int"


def differing_leaves(spark: SparkSession, before: str, after: str) -> tuple[list[int], list[int]]:
    """The leaves whose digests differ, and how many nodes were compared on each level.

    A level is one folder, and of it only the children of differing nodes take
    part. What reaches the driver is at most one number for each of 2**16 leaves.
    """
    nodes, compared = [0], []
    for level in range(LEVELS + 1):
        parents = literal_rows(spark, "parent int", [(n,) for n in nodes])
        up = F.shiftright("node", FAN_BITS) if level else F.col("node")
        a, b = (
            spark.read.schema(_NODE).parquet(f"{path}/tree").filter(F.col("level") == level)
            .withColumn("parent", up).join(parents, "parent", "left_semi")
            .select("node", F.struct("n_rows", *SUMS).alias(name)) for path, name in ((before, "a"), (after, "b")))
        rows = a.join(b, "node", "full_outer").select("node", F.col("a").eqNullSafe(F.col("b")).alias("same")).collect()
        compared.append(len(rows))
        nodes = sorted(r["node"] for r in rows if not r["same"])
        if not nodes:
            break
    return (nodes if len(compared) == LEVELS + 1 else []), compared


def rows_of_leaves(spark: SparkSession, path: str, keys: T.StructType, leaves: list[int]) -> DataFrame:
    """Keys and row digests in these leaves; other folders and row groups are not read."""
    schema = T.StructType(keys.fields + [T.StructField("_leaf", T.IntegerType())]
                          + [T.StructField(p, T.LongType()) for p in _PARTS]
                          + [T.StructField("_folder", T.IntegerType())])
    folders = sorted({leaf >> (LEAF_BITS - FOLDER_BITS) for leaf in leaves})
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(
        F.col("_folder").isin(folders) & F.col("_leaf").isin(leaves))


def changed_keys(spark: SparkSession, before: str, after: str, keys: T.StructType) -> DataFrame:
    """Keys that are NEW, CHANGED or DELETED between two written snapshots, as `change_status` says it."""
    leaves, _ = differing_leaves(spark, before, after)
    sides = [rows_of_leaves(spark, path, keys, leaves).select(*[f"`{f.name}`" for f in keys.fields], *_PARTS)
             for path in (before, after)]
    return change_status(*sides, [f.name for f in keys.fields]).filter("change_status <> 'UNCHANGED'")
