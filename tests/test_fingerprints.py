import uuid

from pyspark.sql import functions as F

from moveproof.operators import profile
from moveproof.session import tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def shuffled_octets(spark, frame):
    """Octets that the jobs of a frame write to shuffles, as the scheduler counts them."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        frame().collect()
        tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
        return sum(store.stageAttempt(s, 0, False, None, False, None)._1().shuffleWriteBytes() for s in stages
                   if tracker.getStageInfo(s) is not None)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_same_counts_as_whole_rows(spark, root):
    frames = tables(spark, root)
    frames["twice"] = frames["orders"].unionByName(frames["orders"].filter("o_orderkey % 3 = 0"))
    frames["none"] = frames["orders"].limit(0)
    assert rows(profile.duplicate_rows_by_fingerprint(frames)) == rows(profile.duplicate_rows(frames))


def test_nulls_nans_zeros_and_nesting(spark):
    data = [(None, "a", [1, None]), (float("nan"), "a", [1, None]), (0.0, "b", None), (-0.0, "b", None),
            (1.0, None, [None, 1]), (1.0, "", [None, 1]), (1.0, "x" * 200, []), (1.0, "x" * 200, [])]
    df = spark.createDataFrame(data, "x double, s string, v array<int>")
    got, = profile.duplicate_rows_by_fingerprint({"t": df}).collect()
    assert rows(profile.duplicate_rows({"t": df})) == [tuple(got)]
    assert got.duplicate_rows == 3


def test_rows_of_equal_fingerprint_are_told_apart(spark, monkeypatch):
    df = spark.range(90).select((F.col("id") % 40).alias("k"))
    monkeypatch.setattr(profile, "_fingerprint", lambda df: (F.col("k") % 2, F.lit(0).cast("long")))
    got, = profile.duplicate_rows_by_fingerprint({"t": df}).collect()
    assert (got.total_rows, got.duplicate_rows) == (90, 50)


def test_wide_rows_shuffle_less_than_half(spark, root):
    frames = tables(spark, root, ("documents", "pages"))
    whole = shuffled_octets(spark, lambda: profile.duplicate_rows(frames))
    prints = shuffled_octets(spark, lambda: profile.duplicate_rows_by_fingerprint(frames))
    assert 0 < prints < 0.5 * whole, (prints, whole)


def test_rows_that_do_not_repeat_are_never_shuffled(spark):
    """Many repeated fingerprints, more than are broadcast for a join, next to long rows that do not repeat."""
    text = F.concat(*[F.sha2(F.concat("id", F.lit(i)).cast("string"), 512) for i in range(40)])
    once = spark.range(2000).select("id", text.alias("text"), *[F.sha2(F.concat("id", F.lit(-i)).cast("string"), 256).alias(f"c{i}") for i in range(20)])
    twice = spark.range(3000).select((F.col("id") % 1000).alias("id"))
    mixed = once.unionByName(once.filter("id % 100 = 0"))
    frames = {"once": once, "twice": twice, "mixed": mixed, "none": once.limit(0)}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        octets = shuffled_octets(spark, lambda: profile.duplicate_rows_by_fingerprint(frames))
        got = {r.dataset: (r.total_rows, r.duplicate_rows) for r in profile.duplicate_rows_by_fingerprint(frames).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {"once": (2000, 0), "twice": (3000, 2000), "mixed": (2020, 20), "none": (0, 0)}
    assert octets < 1_000_000, octets  # the long rows hold 25 MB


def test_a_full_bitmap_passes_more_rows_but_counts_the_same(spark, monkeypatch):
    monkeypatch.setattr(profile, "MOST_BITS", 1 << 15)
    df = spark.range(60_000).select(F.when(F.col("id") < 50_000, F.col("id") % 25_000).otherwise(F.col("id")).alias("k"))
    got, = profile.duplicate_rows_by_fingerprint({"t": df}).collect()
    assert (got.total_rows, got.duplicate_rows) == (60_000, 25_000)
