from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.operators.drift import schema_versions
from moveproof.streaming import tables as st

KV = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def state(spark, table):
    return {r["k"]: r["v"] for r in table.read(spark).collect()}


def feed(spark, folder, rows, schema="k long, v string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_changes_survive_a_restart_and_a_replay(spark, tmp_path):
    base = str(tmp_path)
    table = st.ChangeTable(spark, f"{base}/t", KV, ["k"])
    run = lambda cp: st.apply_changes(
        st.file_stream(spark, f"{base}/in", KV), table, f"{base}/{cp}")
    feed(spark, f"{base}/in", [(1, "a"), (2, "b")])
    run("c1")
    feed(spark, f"{base}/in", [(2, "B"), (3, "c"), (1, "a")])
    run("c1")
    run("c1")  # nothing new
    assert state(spark, table) == {1: "a", 2: "B", 3: "c"}
    assert table.read(spark, before=1).count() == 2  # the unchanged row wrote nothing twice
    # the same batch again, as after a crash between write and commit
    rows = spark.createDataFrame([(2, "B", False), (3, "c", False)], table.schema)
    table.write(rows, 1)
    assert state(spark, table) == {1: "a", 2: "B", 3: "c"}
    small = table.compact(spark, f"{base}/compact")
    assert state(spark, small) == state(spark, table)


def test_tombstones(spark, tmp_path):
    base = str(tmp_path)
    schema = T.StructType([*KV.fields, T.StructField("gone", T.BooleanType())])
    table = st.ChangeTable(spark, f"{base}/t", KV, ["k"])
    run = lambda: st.apply_changes(
        st.file_stream(spark, f"{base}/in", schema), table, f"{base}/c", "gone")
    feed(spark, f"{base}/in", [(1, "a", False), (2, "b", None)], "k long, v string, gone boolean")
    run()
    feed(spark, f"{base}/in", [(1, None, True), (9, None, True)], "k long, v string, gone boolean")
    run()
    assert state(spark, table) == {2: "b"}
    feed(spark, f"{base}/in", [(1, "again", False)], "k long, v string, gone boolean")
    run()
    assert state(spark, table) == {1: "again", 2: "b"}


def test_a_long_log_is_folded_and_replays_still_see_their_past(spark, tmp_path):
    base = str(tmp_path)
    schema = T.StructType([*KV.fields, T.StructField("gone", T.BooleanType())])
    table = st.ChangeTable(spark, f"{base}/t", KV, ["k"], buckets=4, compact_every=2)
    for i in range(6):
        feed(spark, f"{base}/in", [(i, f"v{i}", False), (0, f"w{i}", i == 4)], "k long, v string, gone boolean")
        st.apply_changes(st.file_stream(spark, f"{base}/in", schema), table, f"{base}/c", "gone")
    assert sorted(r[0] for r in spark.read.parquet(f"{base}/t/bases").collect()) == [2, 4]
    assert state(spark, table) == {0: "w5", **{i: f"v{i}" for i in range(1, 6)}}
    past = {r["k"]: r["v"] for r in table.read(spark, before=3).collect()}
    assert past == {0: "w2", 1: "v1", 2: "v2"}
    only = spark.createDataFrame([(3,), (77,)], "k long")
    plan = table.read(spark, only=only)
    assert [tuple(r) for r in plan.collect()] == [(3, "v3")]
    assert "PartitionFilters: [key_bucket" in plan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_last_row_of_a_key_wins(spark, tmp_path):
    base = str(tmp_path)
    schema = T.StructType([*KV.fields, T.StructField("at", T.LongType())])
    table = st.ChangeTable(spark, f"{base}/t", schema, ["k"], order=["at"])
    run = lambda: st.apply_changes(
        st.file_stream(spark, f"{base}/in", schema), table, f"{base}/c")
    feed(spark, f"{base}/in", [(1, "late", 9), (1, "early", 2), (2, "x", 1)],
         "k long, v string, at long")
    run()
    assert state(spark, table) == {1: "late", 2: "x"}
    feed(spark, f"{base}/in", [(1, "out of order", 5), (2, "y", 3)], "k long, v string, at long")
    run()
    assert state(spark, table) == {1: "late", 2: "y"}


def test_ingest_in_steps_equals_one_batch(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("n", "d")])
    rows = [(str(i) if i % 10 else "bad", "2024-01-0" + str(1 + i % 9)) for i in range(60)]

    def ingest(name, parts):
        base = str(tmp_path / name)
        for i in range(parts):
            feed(spark, f"{base}/in", rows[i::parts], "n string, d string")
            st.ingest_files(st.file_stream(spark, f"{base}/in", schema), f"{base}/out",
                            f"{base}/c", {"n": "INTEGER", "d": "DATE"}, "2026-01-01")
        read = lambda part: spark.read.parquet(f"{base}/out/{part}")
        return read("data").drop("source_file", "batch"), read("quarantine"), read("history")

    many, bad, history = ingest("steps", 3)
    once, _, _ = ingest("once", 1)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, once.collect()))
    assert bad.count() == 6 and many.count() == 54
    assert history.agg(F.sum("rows_rejected")).first()[0] == 6


def test_files_are_archived(spark, tmp_path):
    base = str(tmp_path)
    schema = T.StructType([T.StructField("n", T.StringType())])
    for i in range(2):
        feed(spark, f"{base}/in", [(str(i),)], "n string")
        st.ingest_files(
            st.file_stream(spark, f"{base}/in", schema, files_per_batch=1,
                           archive=f"{base}/done"),
            f"{base}/out", f"{base}/c", {"n": "INTEGER"}, "2026-01-01")
    assert sorted(r["n"] for r in spark.read.parquet(f"{base}/out/data").collect()) == [0, 1]


def test_strict_drift_quarantines_unknown_keys(spark, tmp_path):
    base = str(tmp_path)
    schema = T.StructType([T.StructField("doc", T.StringType())])
    feed(spark, f"{base}/in", [('{"a": 1}',), ('{"a": 1, "new": 2}',), (None,)], "doc string")
    st.drift_batches(st.file_stream(spark, f"{base}/in", schema), "t", "doc", f"{base}/out",
                     f"{base}/c", ["a"], evolve=False)
    assert spark.read.parquet(f"{base}/out/rows").count() == 2
    assert spark.read.parquet(f"{base}/out/quarantine").count() == 1
    assert [tuple(r)[:3] for r in spark.read.parquet(f"{base}/out/drift").collect()] == [("t", "new", "ADDED")]


def test_versions_across_pieces(spark):
    """A table with most of the log gets the numbers one pass over it would give."""
    states = ["a", "a", "b", "b", "a", "c", "c", "c", "a", "a"] * 30
    log = spark.createDataFrame(
        [("t", i, i // 17, s) for i, s in enumerate(states)] + [("u", 0, 0, "a")],
        "table string, n long, chunk long, columns string")
    got = {r["n"]: (r["version"], r["is_new_version"]) for r in
           schema_versions(log, "chunk", ["n"]).filter("table = 't'").collect()}
    version, last = 0, None
    for i, s in enumerate(states):
        version += s != last
        assert got[i] == (version, s != last)
        last = s
