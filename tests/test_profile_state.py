from pyspark.sql import functions as F

from moveproof.operators import profile
from moveproof.operators import profile_state as ps
from moveproof.session import tables
from moveproof.streaming import tables as st

EXACT = ("dataset", "column", "ordinal", "detected_type", "total_rows", "null_count", "non_null_count")


def rows(df, columns=EXACT):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def errors(states, exact):
    joined = ps.state_profile(states).select("dataset", "column", F.col("unique_value_count").alias("about")).join(
        exact.select("dataset", "column", "unique_value_count"), ["dataset", "column"]).collect()
    return {(r.dataset, r.column): abs(r.about - r.unique_value_count) / max(r.unique_value_count, 1) for r in joined}


def test_merged_states_equal_the_exact_profile(spark, root):
    frames = tables(spark, root, ("orders", "events", "documents", "embeddings", "nation"))
    parts = [{n: df.filter(F.pmod(F.xxhash64(*[c for c in df.columns if c != "embedding"]), F.lit(4)) == i)
              for n, df in frames.items()} for i in range(4)]
    states = profile.union_all(ps.column_states(p) for p in parts)
    exact = profile.profile_columns(frames)
    assert rows(ps.state_profile(states)) == rows(exact)
    found = errors(states, exact)
    assert max(found.values()) <= ps.ERROR_BOUND, found
    again = ps.merged_states(profile.union_all([
        ps.merged_states(profile.union_all(ps.column_states(p) for p in parts[:3])), ps.column_states(parts[3])]))
    assert rows(ps.state_profile(again), (*EXACT, "unique_value_count", "least", "greatest")) == rows(
        ps.state_profile(states), (*EXACT, "unique_value_count", "least", "greatest"))


def test_error_against_exact_counts(spark):
    sizes = [1, 50, 1000, 20_000, 150_000]
    df = spark.range(300_000).select(*[(F.xxhash64("id", F.lit(n)) % n).alias(f"c{n}") for n in sizes])
    parts = [ps.column_states({"t": df.filter(F.col("c1000") % 3 == i)}) for i in (-2, -1, 0, 1, 2)]
    found = errors(profile.union_all(parts), profile.profile_columns({"t": df}))
    assert all(e <= ps.ERROR_BOUND for e in found.values()), found
    assert found["t", "c1"] == found["t", "c50"] == 0


def test_nan_nesting_and_empty_batches(spark):
    df = spark.createDataFrame([(1.5, [1, None], "a"), (float("nan"), [None, 1], None), (None, [1, None], "a")],
                               "x double, v array<int>, s string")
    states = ps.column_states({"t": df}).unionByName(ps.column_states({"t": df.limit(0)}))
    got = {r.column: (r.total_rows, r.null_count, r.unique_value_count, r.least, r.greatest)
           for r in ps.state_profile(states).collect()}
    assert got == {"x": (3, 2, 1, 1.5, 1.5), "v": (3, 0, 2, None, None), "s": (3, 1, 1, None, None)}


def test_states_across_restarts_replays_and_merging(spark, tmp_path):
    states = st.ProfileStates(str(tmp_path / "out"), "t", compact_every=2)
    schema = spark.createDataFrame([], "k long, v string").schema
    whole = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    for i in range(6):
        part = whole.filter(F.col("k") % 6 == i)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        states.run(st.file_stream(spark, str(tmp_path / "in"), schema, "parquet"), str(tmp_path / "check"))
    wanted = rows(profile.profile_columns({"t": whole}))
    assert rows(states.profile(spark)) == wanted
    last = whole.filter(F.col("k") % 6 == 5)
    states.apply(last, 5)  # the same batch again, as after a lost driver
    fourth = whole.filter(F.col("k") % 6 == 4)
    states.apply(fourth, 4)  # also one that merges
    assert rows(states.profile(spark)) == wanted
    assert states.states(spark).count() == 2 * 3  # the merged state and two batches of two columns
