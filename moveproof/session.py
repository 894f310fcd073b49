"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(master: str | None = None, app: str = "moveproof", **conf) -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE, no UI."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def tables(spark: SparkSession, root: str, names=TABLES) -> dict[str, DataFrame]:
    """Several tables; their schemas are read at the same time, as each is a small job."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(names, pool.map(lambda n: table(spark, root, n), names)))


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A rule- or schema-sized table as a LocalRelation.

    Its size is known to the optimizer, so joins against it broadcast by the
    session's size threshold instead of by hint.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct.fields)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)


#: Folders made for local sessions; they go when the process ends.
_OWN: list[tempfile.TemporaryDirectory] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names.

    Only a local-mode session without `spark.checkpoint.dir` gets a folder of
    its own; on a cluster the setting is required, since executors cannot see
    a driver's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _OWN.append(tempfile.TemporaryDirectory(prefix="moveproof-", ignore_cleanup_errors=True))
        base = _OWN[-1].name
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Whether a run's shuffle files go with it; read when a frame is made.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames made and run inside go when a run ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder, for results that several steps read.

    The scans behind it run once, and a lost executor costs a re-read of the
    small stored result instead of another pass over the source tables.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
