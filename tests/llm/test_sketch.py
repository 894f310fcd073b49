import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moveproof.llm import sketch
from moveproof.llm.frames import send_code


def hashes():
    def of(batches):
        for batch in batches:
            yield batch.column("h").to_numpy().astype(np.uint64)
    return of


def numbers(spark, n, tasks):
    send_code(spark)
    return spark.range(n, numPartitions=tasks).select(F.abs(F.xxhash64(F.col("id") % 500)).alias("h"))


def test_a_thousand_partitions_are_merged_in_levels(spark):
    df = numbers(spark, 4000, 1000)
    cells = 1 << 10
    got = sketch.frequencies(df, hashes(), cells)
    values = np.array([r.h for r in df.collect()], np.uint64)
    wanted = np.bincount(sketch.cells_of(values, 0, 10).astype(np.int64), minlength=cells)
    assert (got == wanted).all()


def test_no_group_holds_more_than_a_few_arrays(spark):
    df = numbers(spark, 2000, 200)
    layout = "block long, n long, most long"

    def one(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([1])], ["block", "n", "most"])

    def merge(table):
        n, most = table.column("n").to_numpy(), table.column("most").to_numpy()
        return pa.table({"block": table.column("block")[:1], "n": pa.array([int(n.sum())]),
                         "most": pa.array([max(len(n), int(most.max()))])})

    r, = sketch.folded(df.mapInArrow(one, layout), "block", merge, layout).collect()
    assert (r.n, r.most) == (200, sketch.FAN)


def test_repeats_and_members_equal_counting(spark):
    df = numbers(spark, 1200, 70)
    values, counts = np.unique(np.array([r.h for r in df.collect()], np.uint64), return_counts=True)
    seen = sketch.repeats(df, hashes(), 1 << 16, 3)
    assert seen.repeated(values[counts >= 2]).all() and seen.hot(values[counts >= 3]).all()
    assert seen.hot(values[counts < 3]).mean() < 0.05
    inside = sketch.members(df, "h", 1 << 16)
    assert inside(values).all() and inside(values + np.uint64(1)).mean() < 0.05
