import random

import pytest
from pyspark.sql import types as T

from moveproof.streaming import tables as st
from moveproof.streaming.aggregates import AggregateView

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("g", T.StringType()), T.StructField("v", T.LongType())])


def full(table, spark):
    sums = {}
    for r in table.read(spark).collect():
        n, v = sums.get(r.g, (0, None))
        sums[r.g] = (n + 1, v if r.v is None else (v or 0) + r.v)
    return sums


def kept(view, spark):
    return {r.g: (r.n_rows, None if r.sum_v is None else int(r.sum_v)) for r in view.read(spark).collect()}


def write(spark, table, batch, rows):
    table.write(spark.createDataFrame([(*r, False) if len(r) == 3 else r for r in rows], table.schema), batch)


def test_equals_recomputation_after_every_kind_of_change(spark, tmp_path):
    rng = random.Random(5)
    table = st.ChangeTable(spark, f"{tmp_path}/t", ROW, ["k"], buckets=4)
    view = AggregateView(table, f"{tmp_path}/v", ["g"], ["v"], buckets=5)
    live, batch = {}, 0
    for step in range(5):
        for _ in range(rng.choice([1, 2])):
            rows = []
            for k in rng.sample(range(40), 12):
                if k in live and rng.random() < 0.4:
                    rows.append((k, *live.pop(k), True))
                else:
                    live[k] = (rng.choice(["a", "b", "c", None, "d" * 80]), rng.choice([None, rng.randrange(-50, 50)]))
                    rows.append((k, *live[k], False))
            write(spark, table, batch, rows)
            batch += 1
        view.refresh(spark)
        assert view.version(spark) == batch - 1
        assert {g: n for g, (n, _) in kept(view, spark).items()} == {g: n for g, (n, _) in full(table, spark).items()}
        assert kept(view, spark) == full(table, spark)
    assert view.refresh(spark) == []


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    table = st.ChangeTable(spark, f"{tmp_path}/t", ROW, ["k"])
    view = AggregateView(table, f"{tmp_path}/v", ["g"], ["v"], buckets=8)
    write(spark, table, 0, [(i, f"g{i % 40}", i) for i in range(200)])
    everywhere = view.refresh(spark)
    assert len(everywhere) == 8
    before = kept(view, spark)
    write(spark, table, 1, [(3, "g3", 1000)])
    touched = view.refresh(spark)
    assert len(touched) == 1
    written = sorted(p.name for p in (tmp_path / "v/state/version=1").iterdir() if p.name.startswith("bucket"))
    assert written == [f"bucket={touched[0]}"]
    assert kept(view, spark) == before | {"g3": (before["g3"][0], before["g3"][1] + 997)}
    for folder in (tmp_path / "v/state/version=0").iterdir():  # untouched buckets could even be gone for a refresh
        if folder.name.startswith("bucket") and folder.name != f"bucket={touched[0]}":
            for file in folder.iterdir():
                file.write_bytes(b"unreadable")
    write(spark, table, 2, [(3, "g3", 1)])
    assert view.refresh(spark) == touched


def test_emptied_groups_and_buckets_go(spark, tmp_path):
    table = st.ChangeTable(spark, f"{tmp_path}/t", ROW, ["k"])
    view = AggregateView(table, f"{tmp_path}/v", ["g"], ["v"], buckets=3)
    assert view.refresh(spark) == [] and kept(view, spark) == {}
    write(spark, table, 0, [(1, "a", 5), (2, "b", 6)])
    view.refresh(spark)
    write(spark, table, 1, [(1, "a", 5, True)])
    view.refresh(spark)
    assert kept(view, spark) == {"b": (1, 6)}
    write(spark, table, 2, [(2, "b", 6), (9, "x", 1, True)])  # changes that change nothing
    assert view.refresh(spark) == [] and view.version(spark) == 2
    assert kept(view, spark) == {"b": (1, 6)}


def test_sums_of_reals_are_refused(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType())])
    with pytest.raises(ValueError):
        AggregateView(st.ChangeTable(spark, f"{tmp_path}/t", schema, ["k"]), f"{tmp_path}/v", ["k"], ["x"])
