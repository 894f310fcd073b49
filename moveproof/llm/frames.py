"""What the operators share: row identity, the shared folder, sizes."""

from __future__ import annotations

import ctypes
import math
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moveproof.session import stored as stored  # noqa: F401

LAST_ID = (1 << 63) - 1
BATCH_BYTES = "4m"


#: Per application the folder whose archive its executors fetch; kept as long as this process.
_sent: dict[str, tempfile.TemporaryDirectory] = {}


def send_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as `--py-files` would.

    Tasks import the operators' modules by name, wherever the driver found them. The
    batches of texts that tasks exchange with Python are bounded too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.TemporaryDirectory(prefix="moveproof-code-", ignore_cleanup_errors=True)
    copy = os.path.join(folder.name, "code")
    shutil.copytree(os.path.join(root, "moveproof"), os.path.join(copy, "moveproof"),
                    ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder.name, "moveproof"), "zip", copy)
    context.addPyFile(os.path.realpath(archive))
    _sent[context.applicationId] = folder


def _give_back() -> None:
    """Return the memory that this process has freed but kept; a C library without such a call keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work on batches; at its end the worker, which the next tasks use again, gives its memory back."""
    def rows(batches):
        try:
            yield from work(batches)
        finally:
            _give_back()
    return rows


def identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **others: str
) -> DataFrame:
    """id, key, text: what operators need of documents, under names of their own.

    `others` names further columns to carry, as new name = column.

    `id` is the document's id, a null id counting as the largest. `key` tells
    rows of equal id but unequal text apart; repeated rows share both and get
    the same result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(text).alias("key"), text.alias("text"),
        *[F.col(f"`{column}`").alias(name) for name, column in others.items()])


def public_id(name: str = "id") -> Column:
    return F.when(F.col(name) != LAST_ID, F.col(name))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def power_of_two(n: float, least: int, most: int) -> int:
    return min(max(least, 1 << math.ceil(math.log2(max(n, 1)))), most)


def partitions(df: DataFrame, data_bytes: float, each: int = 16 << 20) -> int:
    """Shuffle partitions so that one holds about `each` bytes; at least the session's number."""
    have = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(have, math.ceil(data_bytes / each))
