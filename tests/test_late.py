import datetime

from pyspark.sql import types as T

from moveproof.streaming import tables as st
from moveproof.streaming.late import EventTimeIngest

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()),
                       T.StructField("v", T.StringType())])
START = datetime.datetime(2024, 5, 1)


def at(hours, micros=0):
    return START + datetime.timedelta(hours=hours, microseconds=micros)


def feed(spark, base, ingest, rows):
    spark.createDataFrame([(i, t, v) for i, t, v in rows], SCHEMA).write.mode("append").parquet(f"{base}/in")
    ingest.run(st.file_stream(spark, f"{base}/in", SCHEMA, "parquet"))


def result(spark, ingest):
    return (sorted((r.id, r.v) for r in ingest.rows(spark).collect()),
            sorted((r.id, r.v, r.error) for r in ingest.quarantined(spark).collect()))


def test_late_repeated_and_timeless_rows_across_restarts(spark, tmp_path):
    ingest = EventTimeIngest(f"{tmp_path}/out", SCHEMA, "ts", ["id"], "2 hours")
    feed(spark, tmp_path, ingest, [(1, at(0), "a"), (1, at(0), "a"), (2, at(10), "b"), (3, None, "c")])
    again = EventTimeIngest(f"{tmp_path}/out", SCHEMA, "ts", ["id"], "2 hours")  # as after a restart
    feed(spark, tmp_path, again, [
        (4, at(8), "on the mark"), (5, at(8, 1), "just in time"), (2, at(10), "b again"), (1, at(0), "late again"),
        (6, at(20), "d")])
    feed(spark, tmp_path, again, [(7, at(17), "late"), (8, at(19), "e"), (6, at(20), "d again")])
    feed(spark, tmp_path, again, [])
    assert result(spark, again) == (
        [(1, "a"), (2, "b"), (5, "just in time"), (6, "d"), (8, "e")],
        [(1, "late again", "late"), (3, "c", "no event time"), (4, "on the mark", "late"), (7, "late", "late")])


def test_a_replayed_batch_is_judged_as_before(spark, tmp_path):
    ingest = EventTimeIngest(f"{tmp_path}/out", SCHEMA, "ts", ["id"], "1 hour")
    first = [(1, at(0), "a"), (2, at(5), "b")]
    feed(spark, tmp_path, ingest, first)
    feed(spark, tmp_path, ingest, [(3, at(9), "c"), (4, at(1), "late")])
    before = result(spark, ingest)
    ingest.split(spark.createDataFrame(first, SCHEMA), 0)  # the driver went before it could commit
    ingest.split(spark.createDataFrame([(3, at(9), "c"), (4, at(1), "late")], SCHEMA), 1)
    feed(spark, tmp_path, ingest, [(5, at(9), "d")])
    assert result(spark, ingest) == (sorted([*before[0], (5, "d")]), before[1])


def test_a_batch_of_late_rows_alone_moves_nothing(spark, tmp_path):
    ingest = EventTimeIngest(f"{tmp_path}/out", SCHEMA, "ts", ["id"], "1 hour")
    feed(spark, tmp_path, ingest, [(1, at(9), "a")])
    feed(spark, tmp_path, ingest, [(2, at(1), "late")])
    feed(spark, tmp_path, ingest, [(3, at(8, 5), "b"), (4, at(7), "late")])
    assert result(spark, ingest) == ([(1, "a"), (3, "b")], [(2, "late", "late"), (4, "late", "late")])
