"""Changes between two states: keyed rows, whole-table fingerprints, dataset growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveproof.functions.rates import growth_rate
from moveproof.functions.text import common_layout, multiset_hash, row_hashes


def change_status(
    previous: DataFrame, current: DataFrame, keys: list[str], columns: list[str] | None = None
) -> DataFrame:
    """NEW / CHANGED / UNCHANGED / DELETED per key.

    Both sides are reduced to key and row hashes and folded with one group-by
    instead of a full outer join: a repeated key adds up instead of producing
    all pairs, hot keys merge inside each task, and no row content is shuffled.
    A key is UNCHANGED when both sides hold the same multiset of rows. Values
    are compared, not layouts: columns by name in any order, values in a type
    that holds both sides', and a column that one side lacks as null there.
    """
    layout = common_layout(previous.schema, current.schema, keys)
    if columns is not None:
        layout = [(name, dtype) for name, dtype in layout if name in columns]
    quoted = [F.col(f"`{k}`") for k in keys]

    def side(df, is_current):
        first, second = row_hashes(df, layout)
        return df.select(
            *quoted, first.alias("_h1"), second.alias("_h2"), F.lit(is_current).alias("_is_current"),
        )

    both = side(previous, False).unionByName(side(current, True))
    now, before = F.col("_is_current"), ~F.col("_is_current")
    sums_now = multiset_hash(F.col("_h1"), F.col("_h2"), now)
    sums_before = multiset_hash(F.col("_h1"), F.col("_h2"), before)
    folded = both.groupBy(*quoted).agg(
        F.count_if(before).alias("rows_before"), F.count_if(now).alias("rows_now"),
        *[c.alias(f"b{i}") for i, c in enumerate(sums_before)],
        *[c.alias(f"n{i}") for i, c in enumerate(sums_now)],
    )
    equal = F.col("rows_before") == F.col("rows_now")
    for i in range(len(sums_now)):
        equal = equal & (F.col(f"b{i}") == F.col(f"n{i}"))
    return folded.select(
        *quoted,
        F.when(F.col("rows_before") == 0, "NEW").when(F.col("rows_now") == 0, "DELETED")
        .when(equal, "UNCHANGED").otherwise("CHANGED").alias("change_status"),
        "rows_before", "rows_now",
    )


FINGERPRINT_BUCKETS = 4096


def table_fingerprint(df: DataFrame, dataset: str) -> DataFrame:
    """Row count and an order-insensitive content hash of a table.

    Rows are summed per hash bucket first, so the 64-bit sums hold for any
    table size; the bucket rows are then digested in bucket order.
    """
    first, second = row_hashes(df)
    hashed = df.select(first.alias("h1"), second.alias("h2"))
    per_bucket = hashed.groupBy(F.pmod("h1", F.lit(FINGERPRINT_BUCKETS)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        *[c.alias(f"s{i}") for i, c in enumerate(multiset_hash(F.col("h1"), F.col("h2")))],
    )
    line = F.struct("bucket", F.concat_ws(":", "bucket", "n", *[f"s{i}" for i in range(8)]).alias("t"))
    return per_bucket.agg(
        F.lit(dataset).alias("dataset"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "|"),
               256).alias("fingerprint"),
    )


def bucket_fingerprints(df: DataFrame, dataset: str) -> DataFrame:
    """Row counts and content sums of sixteen buckets, from digests any engine can compute.

    A row's digest is the MD5 of its values as text, joined by "|", nulls as "~"; the
    first hex digit names the bucket, the next eight are summed, which holds 2**31
    rows of a bucket times 2**32.
    """
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns]
    digest = F.md5(F.concat_ws("|", *text))
    part = F.conv(F.substring(digest, 2, 8), 16, 10).cast("long")
    return df.groupBy(F.substring(digest, 1, 1).alias("bucket")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(part).alias("fingerprint"),
    ).select(F.lit(dataset).alias("dataset"), "bucket", "row_count", "fingerprint")


def dataset_growth(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Status and growth of every dataset of two snapshots (database, dataset, record_count)."""
    keys = ["database", "dataset"]
    p = previous.select(*keys, F.col("record_count").alias("p"))
    c = current.select(*keys, F.col("record_count").alias("c"))
    before, now = F.coalesce("p", F.lit(0)), F.coalesce("c", F.lit(0))
    return p.join(c, keys, "full_outer").select(
        *keys,
        F.when(F.col("p").isNull(), "NEW_DATASET").when(F.col("c").isNull(), "REMOVED_DATASET")
        .when(now > before, "GROWTH").when(now < before, "REDUCTION").otherwise("NO_CHANGE")
        .alias("status"),
        before.alias("previous_record_count"), now.alias("current_record_count"),
        (now - before).alias("record_growth"),
        F.when(F.col("p").isNull(), F.lit(None)).when(F.col("c").isNull(), F.lit(-100.0))
        .otherwise(growth_rate(before, now)).alias("growth_rate_percent"),
    )


def growth_summary(growth: DataFrame) -> DataFrame:
    """Totals per database; a database without an earlier snapshot becomes a baseline."""
    known = growth.groupBy("database").agg(
        F.count_if(F.col("status") != "NEW_DATASET").alias("seen_before"),
        F.sum("previous_record_count").alias("p"),
        F.sum("current_record_count").alias("c"),
        *[
            F.count_if(F.col("status") == s).alias(a)
            for s, a in (
                ("GROWTH", "datasets_with_growth"), ("REDUCTION", "datasets_with_reduction"),
                ("NO_CHANGE", "datasets_without_change"), ("NEW_DATASET", "new_datasets"),
                ("REMOVED_DATASET", "removed_datasets"),
            )
        ],
    )
    analyzed = F.col("seen_before") > 0
    return known.select(
        "database",
        F.when(analyzed, "ANALYZED").otherwise("BASELINE_CREATED").alias("growth_status"),
        F.when(analyzed, F.col("p")).alias("previous_total_records"),
        F.col("c").alias("current_total_records"),
        F.when(analyzed, F.col("c") - F.col("p")).alias("total_record_growth"),
        F.when(analyzed, growth_rate(F.col("p"), F.col("c"))).alias("overall_growth_rate_percent"),
        "datasets_with_growth", "datasets_with_reduction", "datasets_without_change",
        F.when(analyzed, F.col("new_datasets")).otherwise(0).cast("long").alias("new_datasets"),
        "removed_datasets",
    )


def discovery_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("database").agg(
        F.count(F.lit(1)).alias("total_datasets"), F.sum("record_count").alias("total_records")
    )


def largest_datasets(inventory: DataFrame, k: int = 10) -> DataFrame:
    """The k datasets with most records; the name breaks ties."""
    return inventory.orderBy(F.desc("record_count"), "database", "dataset").limit(k)
