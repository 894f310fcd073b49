import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from compare import duck
from moveproof.operators import inclusion, key_search, keys
from moveproof.plans.discovering import FAMILY, KEY_LAYOUT
from moveproof.session import FREED, TABLES, tables


def pairs(df):
    return {((r.child, r.child_key), (r.parent, r.parent_key)): r for r in df.collect()}


def test_inclusions_equal_except_per_column_pair(spark, root):
    con = duck(root)
    columns = [(t, c, FAMILY[k]) for t in TABLES for c, k in KEY_LAYOUT[t] if k in FAMILY and c != "embedding"]
    expected = set()
    for t, c, f in columns:
        if not con.execute(f"SELECT count({c}) FROM {t}").fetchone()[0]:
            continue
        for u, d, g in columns:
            if f == g and (t, c) != (u, d) and not con.execute(
                    f"SELECT {c} FROM {t} WHERE {c} IS NOT NULL EXCEPT SELECT {d} FROM {u} LIMIT 1").fetchall():
                expected.add(((t, c), (u, d)))
    assert set(pairs(inclusion.inclusions(tables(spark, root)))) == expected


def test_shares_uniqueness_and_more_columns_than_a_word(spark):
    rng = random.Random(4)
    data = [[rng.randrange(40) if rng.random() < 0.9 else None for _ in range(70)] for _ in range(60)]
    wide = spark.createDataFrame(data, ", ".join(f"c{i} long" for i in range(70)))
    keyed = spark.range(45).selectExpr("CAST(id AS INT) AS k", "CAST(id % 7 AS DECIMAL(9,0)) AS few")
    values = {("wide", f"c{i}"): [r[i] for r in data if r[i] is not None] for i in range(70)}
    values |= {("keyed", "k"): list(range(45)), ("keyed", "few"): [i % 7 for i in range(45)]}
    got = pairs(inclusion.inclusions({"wide": wide, "keyed": keyed}, min_share=0.5))
    wanted = {}
    for a, x in values.items():
        for b, y in values.items():
            shared = len(set(x) & set(y))
            if a != b and 2 * shared >= len(set(x)):
                wanted[a, b] = (len(set(x)), shared, len(set(y)), len(set(y)) == len(y))
    assert {p: (r.child_values, r.shared_values, r.parent_values, r.parent_unique) for p, r in got.items()} == wanted
    exact = pairs(inclusion.inclusions({"wide": wide, "keyed": keyed}))
    assert set(exact) == {p for p, w in wanted.items() if w[0] == w[1]}


def test_families_long_texts_and_empty_columns(spark):
    a = spark.sql("SELECT 1 AS n, '1' AS s, DATE'1970-01-02' AS d, repeat('x', 90) AS t, CAST(NULL AS LONG) AS e, 1.0D AS r")
    b = spark.sql("SELECT 1L AS n, repeat('x', 90) AS t, repeat('x', 91) AS u, true AS f")
    got = set(pairs(inclusion.inclusions({"a": a, "b": b})))
    assert got == {(("a", "n"), ("b", "n")), (("b", "n"), ("a", "n")), (("a", "t"), ("b", "t")), (("b", "t"), ("a", "t"))}


def test_a_hot_value_is_folded_in_each_task(spark):
    hot = spark.range(40_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    plan = inclusion.column_sets({"hot": hot})[1]
    assert plan.agg(F.sum("n_values")).first()[0] == hot.distinct().count()
    r, = inclusion.inclusions({"hot": hot, "all": spark.range(40_000)}).filter("child = 'hot'").collect()
    assert (r.child_values, r.parent_unique) == (hot.distinct().count(), True)


def test_discovered_relations_feed_the_orphan_check(spark):
    parent = spark.range(100).withColumnRenamed("id", "pk")
    child = spark.createDataFrame([(i, i % 103) for i in range(1000)], "ck long, ref long")
    frames = {"parent": parent, "child": child}
    found = inclusion.relationships(frames).filter("child_key = 'ref' and parent = 'parent'")
    relation, = inclusion.as_relations(found, frames)
    assert relation["name"] == "child.ref -> parent.pk"
    orphans, = keys.fk_orphans([relation]).collect()
    assert (orphans.orphan_rows, orphans.orphan_keys) == (sum(i % 103 >= 100 for i in range(1000)), 3)


def brute(rows, names, max_size):
    found = []
    for size in range(1, max_size + 1):
        for chosen in combinations(range(len(names)), size):
            if any(set(f) <= set(chosen) for f in found):
                continue
            seen = {tuple(None if r[i] != r[i] else r[i] for i in chosen) for r in rows}
            if rows and len(seen) == len(rows):
                found.append(chosen)
    return {", ".join(names[i] for i in f) for f in found}


@pytest.mark.parametrize("seed", range(6))
def test_minimal_keys_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"c{i}" for i in range(6)]
    wide = [rng.choice([2, 5, 9, 30]) for _ in names]
    nan = float("nan")
    rows = []
    for _ in range(rng.choice([1, 12, 60])):
        cells = [rng.randrange(w) if rng.random() < 0.9 else None for w in wide]
        cells[2] = None if cells[2] is None else rng.choice([nan, float(cells[2])])
        cells[3] = None if cells[3] is None else "long text " * 10 + str(cells[3])
        rows.append(tuple(cells))
    df = spark.createDataFrame(rows, "c0 long, c1 int, c2 double, c3 string, c4 long, c5 long").repartition(3)
    got = key_search.minimal_keys({"t": df}, refuting_rows=rng.choice([1, 8, 1000])).collect()
    assert {r.key for r in got} == brute([tuple(nan if v is None else v for v in r) for r in rows], names, 3)
    assert all(r.null_cells == sum(r2[names.index(c)] is None or r2[names.index(c)] != r2[names.index(c)]
                                   for r2 in rows for c in r.key.split(", ")) for r in got)


def test_no_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")
    assert key_search.minimal_keys({"same": df, "empty": df.limit(0)}).collect() == []


def test_supersets_of_keys_and_poor_combinations_are_never_tested(spark, monkeypatch):
    asked = []
    tested = key_search._repeating
    monkeypatch.setattr(key_search, "_repeating", lambda f, c, rows=None: asked.extend(c) or tested(f, c, rows))
    df = spark.range(500).select("id", (F.col("id") % 2).alias("two"), (F.col("id") % 30).alias("thirty"),
                                 F.floor(F.col("id") / 30).alias("block"))
    got = {r.key for r in key_search.minimal_keys({"t": df}).collect()}
    assert got == {"id", "thirty, block"}
    assert {c for _, c in asked} == {("thirty", "block")}


def test_columns_are_hashed_once_and_few_hashes_are_shuffled(spark):
    names = [f"c{i}" for i in range(8)]
    df = spark.range(100).select(*[(F.col("id") * (i + 3) % 97).cast("string").alias(c) for i, c in enumerate(names)])
    asked = [(i, c) for i, c in enumerate(combinations(names, 3))]
    hashed = key_search._hashed(df, asked)
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") < 30  # two a column, two a combination; not two for each of 56 combinations
    got = {(r.id, r.h1, r.h2) for r in hashed.collect()}
    assert len(got) == 97 * len(asked)  # 97 different rows


def test_a_repeat_in_any_slice_is_found(spark):
    """One frequent value, one pair, and none: the passes over slices and the last one agree with counting."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("often"),
        F.when(F.col("id") == 2999, 0).otherwise(F.col("id")).alias("pair"), F.lit(1).alias("one"),
        F.col("id").alias("never"))
    asked = [("t", (c, "one")) for c in ("often", "pair", "never")]
    assert key_search._repeating({"t": df}, asked) == set(asked[:2])
    assert key_search._repeating_in({"t": df}, asked, 256) == {asked[0]}


def test_passes_are_small_and_equal_brute_force(spark, monkeypatch):
    """No pass takes more rows than it may; columns and combinations larger than that come in parts."""
    rng = random.Random(7)
    nan, names = float("nan"), [f"c{i}" for i in range(4)]
    rows = [tuple(None if rng.random() < 0.02 else rng.randrange(w) for w in (60, 40, 900, 3000)) for _ in range(600)]
    rows = [(*r[:3], None if r[3] is None else nan if r[3] < 9 else float(r[3] - 1500)) for r in rows]
    df = spark.createDataFrame([(r[0], None if r[1] is None else str(r[1]), *r[2:]) for r in rows],
                               "c0 long, c1 string, c2 int, c3 double").repartition(3)
    passes, cells = [], []
    tested, profiled = key_search._repeating_in, key_search.profile_columns
    monkeypatch.setattr(key_search, "LEAST_ROWS", 150)
    monkeypatch.setattr(key_search, "_repeating_in", lambda f, c, slices, part=0, parts=1, tasks=None: (
        passes.append((len(c), slices, part, parts)), tested(f, c, slices, part, parts, tasks))[1])
    monkeypatch.setattr(key_search, "profile_columns", lambda f: (
        cells.extend(d.count() * len(d.columns) for d in f.values()), profiled(f))[1])
    got = {r.key: r for r in key_search.minimal_keys({"t": df}, max_size=2, refuting_rows=1).collect()}
    assert set(got) == brute([tuple(nan if v is None else v for v in r) for r in rows], names, 2) != set()
    assert {r.total_rows for r in got.values()} == {600}
    assert sum(cells) == 4 * 600 and max(cells) < 600
    last = [p for p in passes if p[1] == 1 and p[2:] != (0, 1)]
    assert last and {(n, parts) for n, _, _, parts in last} == {(1, 4)}  # 600 rows in parts of 150
    assert {part for _, _, part, _ in last} == {0, 1, 2, 3}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString("\n").split("\n") if "/shuffle_" in name}


def test_shuffle_files_go_with_their_pass(spark):
    df = spark.range(500).select((F.col("id") % 30).alias("thirty"), F.floor(F.col("id") / 30).alias("block"))
    before, setting = shuffle_files(spark), spark.conf.get(FREED, None)
    assert len(key_search.minimal_keys({"t": df}).collect()) == 1
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(FREED, None) == setting
