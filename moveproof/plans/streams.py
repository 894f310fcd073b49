"""Streaming queries: each feeds a folder in steps and stops the stream between them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.operators import profile
from moveproof.operators.profile_state import ERROR_BOUND
from moveproof.plans.profiling import LAYOUT, counts_sql, share_sql
from moveproof.plans.registry import query
from moveproof.session import literal_rows, scratch_dir, table
from moveproof.streaming import aggregates, late
from moveproof.streaming import tables as st


def steps(spark, folder, frames, run):
    """Write each frame as new files, then let the stream take what is there."""
    for df in frames:
        df.write.mode("append").json(folder)
        run(spark)


EVENT_TEXT = T.StructType([
    T.StructField(c, T.StringType()) for c in ("event_id", "user_id", "event_type", "value")
])


def event_text(spark, root):
    """Events as text, with a price that is no number on some rows."""
    bad = F.col("event_id") % 50 == 0
    value = F.col("value").cast("decimal(18,2)").cast("string")
    return table(spark, root, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"), "event_type",
        F.when(bad, "n/a").otherwise(value).alias("value"),
    )


@query("stream_ingest_events", """
SELECT event_id, user_id, event_type, value, batch FROM (
SELECT event_id, user_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value,
       event_id % 3 AS batch FROM events WHERE event_id % 50 <> 0) e""")
def stream_ingest_events(spark, root):
    base = scratch_dir(spark, "stream-ingest")
    rows = event_text(spark, root)

    def run(spark):
        st.ingest_files(
            st.file_stream(spark, f"{base}/in", EVENT_TEXT), f"{base}/out", f"{base}/checkpoint",
            {"event_id": "BIGINT", "user_id": "BIGINT", "value": "NUMERIC"},
            "2026-01-01T00:00:00", ["event_id"],
        )

    number = F.col("event_id").cast("bigint")
    steps(spark, f"{base}/in", [rows.filter(number % 3 == i) for i in range(3)], run)
    return spark.read.parquet(f"{base}/out/data").select(
        "event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"),
        F.col("batch").cast("bigint").alias("batch"),
    )


CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()),
])


@query("stream_apply_changes", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, '!') ELSE c_name END AS c_name,
       c_acctbal FROM customer WHERE c_custkey % 7 <> 0""")
def stream_apply_changes(spark, root):
    base = scratch_dir(spark, "stream-changes")
    customer = table(spark, root, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.col("c_custkey")
    changes = st.ChangeTable(spark, f"{base}/out", CUSTOMER, ["c_custkey"])
    arriving = T.StructType([*CUSTOMER.fields, T.StructField("gone", T.BooleanType())])

    def run(spark):
        st.apply_changes(
            st.file_stream(spark, f"{base}/in", arriving), changes, f"{base}/checkpoint", "gone"
        )

    live = customer.withColumn("gone", F.lit(False))
    steps(spark, f"{base}/in", [
        live.filter(key % 2 == 0),
        live.withColumn("c_name", F.when(key % 5 == 0, F.concat("c_name", F.lit("!")))
                        .otherwise(F.col("c_name"))),
        customer.filter(key % 7 == 0).withColumn("gone", F.lit(True)),
    ], run)
    return changes.read(spark)


def _batch_counts(column: str, kind: str, ordinal: int) -> str:
    return (
        f"SELECT event_id % 2 AS batch, '{column}' AS \"column\", {ordinal} AS ordinal, "
        f"'{kind}' AS detected_type, count(*) AS total_rows, count(*) - count({column}) AS null_count,"
        f" count(DISTINCT {column}) AS unique_value_count FROM e GROUP BY event_id % 2"
    )


@query("stream_profile", f"""WITH e AS (
SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT batch, "column", ordinal, detected_type, total_rows, null_count,
       {share_sql('null_count', 'total_rows')} AS null_percentage, unique_value_count FROM (
{_batch_counts('event_id', 'BIGINT', 0)} UNION ALL {_batch_counts('event_type', 'TEXT', 1)}
UNION ALL {_batch_counts('value', 'NUMERIC', 2)}) c""")
def stream_profile(spark, root):
    base = scratch_dir(spark, "stream-profile")
    number = F.col("event_id")
    events = table(spark, root, "events").select(
        "event_id", "event_type", F.when(number % 9 != 0, F.col("value")).alias("value")
    )
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ])
    required = literal_rows(
        spark, "dataset string, column string, semantic string", [("events", "value", "required")]
    )

    def run(spark):
        st.profile_batches(
            st.file_stream(spark, f"{base}/in", schema), "events", f"{base}/out",
            f"{base}/checkpoint", required,
        )

    steps(spark, f"{base}/in", [events.filter(number % 2 == i) for i in (0, 1)], run)
    return spark.read.parquet(f"{base}/out/columns").select(
        F.col("batch").cast("bigint").alias("batch"), "column", "ordinal", "detected_type",
        "total_rows", "null_count", "null_percentage", "unique_value_count",
    )


def is_close(exact: str, estimate: str):
    return F.abs(F.col(estimate) - F.col(exact)) <= F.lit(ERROR_BOUND) * F.col(exact) + 1


def ends_sql(dataset: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + (
            f"CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest FROM {dataset}"
            if kind in ("BIGINT", "INTEGER", "NUMERIC") else "NULL, NULL")
        for c, kind in LAYOUT[dataset])


@query("stream_profile_state", f"""WITH counts AS ({counts_sql("events")}), ends AS ({ends_sql("events")})
SELECT dataset, "column", ordinal, detected_type, total_rows, null_count, total_rows - null_count AS non_null_count,
       least, greatest, true AS distinct_is_close FROM counts JOIN ends USING ("column")""")
def stream_profile_state(spark, root):
    """The profile of the whole table from the states of its batches; the table is not read again for it."""
    base = scratch_dir(spark, "stream-profile-state")
    events = table(spark, root, "events")
    states = st.ProfileStates(f"{base}/out", "events", compact_every=2)
    for i in range(5):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i).write.mode("append").parquet(f"{base}/in")
        states.run(st.file_stream(spark, f"{base}/in", events.schema, "parquet"), f"{base}/checkpoint")
    exact = profile.profile_columns({"events": events}).select("column", F.col("unique_value_count").alias("exact"))
    return states.profile(spark).join(exact, "column").select(
        "dataset", "column", "ordinal", "detected_type", "total_rows", "null_count", "non_null_count",
        "least", "greatest", is_close("exact", "unique_value_count").alias("distinct_is_close"))


# batches of five days; some rows come a batch late, some two, some come again in the next batch
ARRIVALS = """
SELECT event_id, ts, user_id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 432000.0) AS BIGINT)
  + CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS batch FROM events"""


@query("stream_event_time", f"""WITH once AS ({ARRIVALS}),
arrivals AS (SELECT * FROM once UNION ALL SELECT event_id, ts, user_id, batch + 1 FROM once WHERE event_id % 7 = 0),
latest AS (SELECT batch, max(ts) AS latest FROM arrivals GROUP BY batch),
marks AS (SELECT b.batch, max(l.latest) - INTERVAL 4 DAYS AS mark FROM latest b LEFT JOIN latest l ON l.batch < b.batch
  GROUP BY b.batch),
judged AS (SELECT a.*, coalesce(ts <= mark, false) AS is_late FROM arrivals a JOIN marks USING (batch))
SELECT event_id, user_id, 'late' AS status FROM judged WHERE is_late
UNION ALL SELECT event_id, any_value(user_id), 'kept' FROM judged WHERE NOT is_late GROUP BY event_id""")
def stream_event_time(spark, root):
    """Late and repeated events under a watermark, the stream stopped and started for every batch."""
    base = scratch_dir(spark, "stream-event-time")
    events = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    number = F.col("event_id")
    day = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 432000)
    once = events.withColumn("batch", day + F.when(number % 13 == 0, 2).when(number % 11 == 0, 1).otherwise(0))
    arrivals = once.unionByName(once.filter(number % 7 == 0).withColumn("batch", F.col("batch") + 1))
    ingest = late.EventTimeIngest(f"{base}/out", events.schema, "ts", ["event_id"], "4 days")
    for i in range(9):
        arrivals.filter(F.col("batch") == i).drop("batch").write.mode("append").parquet(f"{base}/in")
        ingest.run(st.file_stream(spark, f"{base}/in", events.schema, "parquet"))
    kept = ingest.rows(spark).select("event_id", "user_id", F.lit("kept").alias("status"))
    return kept.unionByName(ingest.quarantined(spark).select("event_id", "user_id", F.col("error").alias("status")))


PRICED = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderpriority", T.StringType()), T.StructField("cents", T.LongType()),
])


@query("mv_incremental_orders", """
WITH final AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderpriority,
  CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 THEN 5 ELSE 0 END AS cents
  FROM orders WHERE o_orderkey % 4 <> 0)
SELECT o_custkey, o_orderpriority, count(*) AS n_rows, CAST(sum(cents) AS BIGINT) AS sum_cents FROM final GROUP BY ALL""")
def mv_incremental_orders(spark, root):
    """An aggregated copy refreshed from the change log after inserts, updates that move rows, and deletes."""
    base = scratch_dir(spark, "mv-incremental")
    key = F.col("o_orderkey")
    orders = table(spark, root, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.lit(False).alias("gone"))
    moved = orders.withColumn("cents", F.col("cents") + 5).withColumn(
        "o_custkey", F.when(key % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    changes = st.ChangeTable(spark, f"{base}/out", PRICED, ["o_orderkey"])
    view = aggregates.AggregateView(changes, f"{base}/view", ["o_custkey", "o_orderpriority"], ["cents"])
    arriving = T.StructType([*PRICED.fields, T.StructField("gone", T.BooleanType())])

    def run(spark):
        st.apply_changes(st.file_stream(spark, f"{base}/in", arriving), changes, f"{base}/checkpoint", "gone")
        view.refresh(spark)

    steps(spark, f"{base}/in", [
        orders.filter(key % 3 > 0), orders.filter(key % 3 == 0),
        moved.filter((key % 7 == 0) | (key % 9 == 0)),
        orders.filter(key % 4 == 0).withColumn("gone", F.lit(True)),
    ], run)
    return view.read(spark).withColumn("sum_cents", F.col("sum_cents").cast("long"))


@query("stream_drift", """
WITH k AS (SELECT event_id % 2 AS batch, concat('u', user_id % 40) AS c FROM events
  UNION ALL SELECT event_id % 2, 'k' FROM events
  UNION ALL SELECT 1, concat('late_', user_id % 7) FROM events WHERE event_id % 2 = 1),
s AS (SELECT DISTINCT batch, c FROM k),
known AS (SELECT 0 AS batch, 'k' AS c UNION SELECT 0, 'legacy'
  UNION SELECT 1, 'k' UNION SELECT 1, 'legacy' UNION SELECT 1, c FROM s WHERE batch = 0)
SELECT batch, 'events' AS "table", c AS "column", 'ADDED' AS change FROM
  (SELECT * FROM s EXCEPT SELECT * FROM known) a
UNION ALL SELECT batch, 'events', c, 'REMOVED' FROM (SELECT * FROM known EXCEPT SELECT * FROM s) g""")
def stream_drift(spark, root):
    base = scratch_dir(spark, "stream-drift")
    number = F.col("event_id")
    inner = F.expr("substr(props, 2, length(props) - 2)")
    user = F.col("user_id")
    early = F.format_string('{"u%d": 1, %s}', user % 40, inner)
    late = F.format_string('{"u%d": 1, %s, "late_%d": true}', user % 40, inner, user % 7)
    events = table(spark, root, "events").select(
        "event_id", F.when(number % 2 == 0, early).otherwise(late).alias("doc")
    )
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("doc", T.StringType())
    ])

    def run(spark):
        st.drift_batches(
            st.file_stream(spark, f"{base}/in", schema), "events", "doc", f"{base}/out",
            f"{base}/checkpoint", ["k", "legacy"],
        )

    steps(spark, f"{base}/in", [events.filter(number % 2 == i) for i in (0, 1)], run)
    return spark.read.parquet(f"{base}/out/drift").select(
        F.col("batch").cast("bigint").alias("batch"), "table", "column", "change",
    )
