"""Ingest and load queries. Files and tables go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof.functions import text as tx
from moveproof.operators import scoring, shape
from moveproof.operators.profile import union_all
from moveproof.plans.registry import query
from moveproof.plans.variants import variant, with_variants
from moveproof.session import literal_rows, scratch_dir, table
from moveproof.sources import load, measured, readers, versioned, writers

# --- readers ----------------------------------------------------------------------
@query("csv_ingest_supplier", """
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat(s_name, ', "', s_suppkey, '" é') END
         AS s_name,
       CAST(s_nationkey AS VARCHAR) AS s_nationkey,
       CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS s_acctbal FROM supplier""")
def csv_ingest_supplier(spark, root):
    folder = scratch_dir(spark, "csv-supplier")
    supplier = table(spark, root, "supplier")
    quoted = F.concat("s_name", F.lit(', "'), F.col("s_suppkey").cast("string"), F.lit('" é'))
    supplier.select(
        F.col("s_suppkey").alias("﻿ s_suppkey "),
        F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(quoted).alias(" s_name"),
        "s_nationkey", F.col("s_acctbal").cast("decimal(18,2)").alias("s_acctbal"),
    ).write.csv(folder, header=True, escape='"')
    return readers.read_csv(spark, folder)


@query("csv_na_tokens", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN NULL
            ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
       c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal
FROM customer""")
def csv_na_tokens(spark, root):
    folder = scratch_dir(spark, "csv-customer")
    key = F.col("c_custkey")
    table(spark, root, "customer").select(
        "c_custkey",
        F.when(key % 7 == 0, "N/A").when(key % 11 == 0, "null").when(key % 13 == 0, "NaN")
        .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(key % 5 == 0, "").otherwise(F.col("c_nationkey").cast("string"))
        .alias("c_nationkey"),
        "c_name", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"),
    ).write.csv(folder, header=True)
    return readers.na_to_null(readers.read_csv(spark, folder))


@query("json_ingest_events", """
SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 2 = 0 THEN value END AS value,
       CASE WHEN event_id % 2 = 0 THEN props END AS props,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM events""")
def json_ingest_events(spark, root):
    folder = scratch_dir(spark, "json-events")
    events = table(spark, root, "events")
    user = F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id")
    even = F.col("event_id") % 2 == 0
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")
    events.filter(even).select("event_id", "event_type", user, "value", "props", ts).write.json(folder)
    events.filter(~even).select(ts, "event_type", "event_id", user).write.mode("append").json(folder)
    return readers.read_json(spark, folder).select(
        "event_id", "event_type", "user_id", "value", "props", "ts")


@query("csv_mixed_headers", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  CASE WHEN c_custkey % 3 <> 2 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS c_acctbal,
  c_mktsegment, CASE WHEN c_custkey % 3 = 2 THEN concat('note ', c_custkey) END AS note FROM customer""")
def csv_mixed_headers(spark, root):
    """One folder, three headers: another order, a column less, a column more."""
    folder = scratch_dir(spark, "csv-headers")
    customer = table(spark, root, "customer").withColumn(
        "c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    slot = F.col("c_custkey") % 3
    names = customer.columns
    note = F.format_string("note %d", "c_custkey").alias("note")
    for i, columns in enumerate((names, names[::-1], [note, *[c for c in names if c != "c_acctbal"]])):
        customer.filter(slot == i).select(*columns).write.mode("append").csv(folder, header=True)
    return readers.read_csv(spark, folder).select(*names, "note")


@query("json_array_items", """
SELECT event_id, event_type, value FROM events
UNION ALL SELECT NULL, NULL, NULL FROM events WHERE event_id % 3 = 0
UNION ALL SELECT NULL, NULL, NULL FROM events WHERE event_id % 3 = 0""")
def json_array_items(spark, root):
    """Arrays in which items are objects, numbers and nulls; what is no object is an empty row."""
    folder = scratch_dir(spark, "json-arrays")
    item = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[7, "), item, F.lit(", null]"))).otherwise(
        F.concat(F.lit("["), item, F.lit("]")))
    table(spark, root, "events").select(line.alias("value")).write.text(folder)
    return readers.read_json(spark, folder).select("event_id", "event_type", "value")


def _named_file(lines, folder: str, name: str) -> None:
    """One text file of a given name, as files of other systems have; rows keep their order."""
    spark = lines.sparkSession
    aside = scratch_dir(spark, "file")
    lines.coalesce(1).write.text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    to = hadoop.Path(folder, name)
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(folder))
    part = files.globStatus(hadoop.Path(aside, "part-*"))[0].getPath()
    if files.exists(to):
        files.delete(to, False)
    files.rename(part, to)


LINE_DIGEST = """
lines AS (SELECT file, size, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i
  FROM (SELECT file, size, string_split(body, chr(10)) AS parts FROM files) f),
blocks AS (SELECT file, size, i // 65536 AS block, sha256(string_agg(sha256(line), '' ORDER BY i)) AS hash
  FROM lines GROUP BY ALL)
SELECT file, sha256(concat(size, ':', sha256(string_agg(hash, '' ORDER BY block)))) AS digest
FROM blocks GROUP BY file, size"""


#: Documents in one file of the digest query.
FILE_IDS = 400


@query("file_digests", f"""
WITH files AS (
SELECT doc_id // {FILE_IDS} AS file, string_agg(text, chr(10) ORDER BY doc_id) AS body,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size FROM documents GROUP BY ALL),""" + LINE_DIGEST)
def file_digests(spark, root):
    """All documents as files of neighbouring ids, each written by a task of its own."""
    folder = scratch_dir(spark, "digests")
    docs = table(spark, root, "documents").withColumn("file", F.floor(F.col("doc_id") / FILE_IDS).cast("int"))
    files = docs.agg(F.max("file")).first()[0] + 1
    docs.repartitionById(files, F.col("file")).sortWithinPartitions("doc_id").select("text").write.text(folder)
    return writers.file_digests(spark, folder).withColumn(
        "file", F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"))


@query("ingest_folder", """
WITH n AS (SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders,
  (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS half)
SELECT 'r1' AS run_ts, 'broken.json' AS file, 'broken' AS "table", 0::BIGINT AS rows_inserted,
       1::BIGINT AS rows_rejected, 'FAILED' AS status, 'rows do not fit' AS error FROM n
UNION ALL SELECT 'r1', 'Customers.csv', 'customers', customers, 0, 'SUCCESS', NULL FROM n
UNION ALL SELECT 'r1', 'notes.txt', NULL, 0, 0, 'UNSUPPORTED', 'UNSUPPORTED_FILE' FROM n
UNION ALL SELECT 'r1', 'orders.json', 'orders', orders, 0, 'SUCCESS', NULL FROM n
UNION ALL SELECT 'r2', 'broken.json', 'broken', 0, 1, 'FAILED', 'rows do not fit' FROM n
UNION ALL SELECT 'r2', 'Customers.csv', 'customers', half, 0, 'SUCCESS', NULL FROM n
UNION ALL SELECT 'all', 'rows', 'customers', customers + half, 0, 'SUCCESS', NULL FROM n
UNION ALL SELECT 'all', 'rows', 'orders', orders, 0, 'SUCCESS', NULL FROM n""")
def ingest_folder(spark, root):
    """Good, malformed, unsupported and changed files in one folder, loaded twice."""
    base = scratch_dir(spark, "ingest")
    customer, orders = table(spark, root, "customer"), table(spark, root, "orders")
    header = spark.createDataFrame([(",".join(customer.columns),)], "value string")
    rows = customer.select(F.concat_ws(",", *[F.col(c).cast("string") for c in customer.columns]).alias("value"))
    _named_file(header.union(rows), f"{base}/in", "Customers.csv")
    _named_file(orders.select(F.to_json(F.struct("*")).alias("value")), f"{base}/in", "orders.json")
    nations = table(spark, root, "nation").select(F.to_json(F.struct("*")).alias("value"))
    torn = spark.createDataFrame([('{"n_nationkey": oops',)], "value string")
    _named_file(nations.union(torn), f"{base}/in", "broken.json")
    _named_file(table(spark, root, "region").select("r_name"), f"{base}/in", "notes.txt")
    runs = [load.ingest(spark, f"{base}/in", f"{base}/out", "r1")]
    even = rows.filter(F.split("value", ",")[0].cast("bigint") % 2 == 0)
    _named_file(header.union(even), f"{base}/in", "Customers.csv")
    runs.append(load.ingest(spark, f"{base}/in", f"{base}/out", "r2"))
    columns = ("run_ts", "file", "table", "rows_inserted", "rows_rejected", "status", "error")
    counts = [load.read_loaded(spark, f"{base}/out", name).agg(
        F.lit("all").alias("run_ts"), F.lit("rows").alias("file"), F.lit(name).alias("table"),
        F.count(F.lit(1)).alias("rows_inserted"), F.lit(0).cast("long").alias("rows_rejected"),
        F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error")) for name in ("customers", "orders")]
    return union_all([*(r.select(*columns) for r in runs), *counts])


LISTED = "concat('s3/in.d/', source, '/', doc_id, CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.JSON' " \
    "WHEN 2 THEN '.txt' WHEN 3 THEN '.csv.gz' WHEN 4 THEN '' ELSE '.Parquet' END)"


@query("unsupported_files", f"""
SELECT regexp_extract(path, '([^/]+)$', 1) AS dataset, 'UNSUPPORTED_FILE' AS issue_type, 'LOW' AS severity
FROM (SELECT {LISTED} AS path FROM documents) f
WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) NOT IN ('.csv', '.json')""")
def unsupported_files(spark, root):
    """An inventory of one file for each document, of mixed kinds."""
    return readers.unsupported_names(table(spark, root, "documents").select(F.expr(LISTED).alias("path")))


# --- load modes -----------------------------------------------------------------------
@query("load_append_orders", "SELECT * FROM orders")
def load_append_orders(spark, root):
    path = scratch_dir(spark, "load-append")
    orders = table(spark, root, "orders")
    for half in (0, 1):
        writers.write_table(orders.filter(F.col("o_orderkey") % 2 == half), path, "skip")
    return writers.read_table(spark, path)


@query("load_mode_reload", "SELECT * FROM orders WHERE o_orderkey % 3 <> 0")
def load_mode_reload(spark, root):
    path = scratch_dir(spark, "load-reload")
    orders = table(spark, root, "orders")
    writers.write_table(orders, path, "force")
    writers.write_table(orders.filter(F.col("o_orderkey") % 3 != 0), path, "reload")
    return writers.read_table(spark, path)


@query("doc_load_events", """
SELECT event_id, user_id, value, ts, event_type, props FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, user_id, value, ts, event_type, props FROM events WHERE event_id % 5 = 0""")
def doc_load_events(spark, root):
    path = scratch_dir(spark, "documents")
    docs = table(spark, root, "events").select(
        "event_id", F.struct("user_id", "value", "ts", "event_type", "props").alias("payload")
    )
    writers.write_documents(docs.filter(F.col("event_id") % 7 == 0), path, "NEW")
    writers.write_documents(docs.filter(F.col("event_id") % 2 == 0), path, "CHANGED")
    writers.write_documents(docs.filter(F.col("event_id") % 5 == 0), path, "UNCHANGED")
    return writers.read_table(spark, path).select("event_id", "payload.*")


VERSION_STEPS = ((False, 0, 5), (False, 1, 5), (True, 0, 3), (False, 2, 5))


@query("load_versions_orders", "WITH w AS (" + " UNION ALL ".join(
    f"SELECT {v} AS version, {replaces} AS replaces, (SELECT count(*) FROM orders WHERE o_orderkey % {by} = {rest}) AS rows"
    for v, (replaces, rest, by) in enumerate(VERSION_STEPS)) + """)
SELECT CAST(version AS BIGINT) AS version, replaces, rows, CAST((SELECT sum(o.rows) FROM w o WHERE o.version <= w.version AND o.version >= (
  SELECT coalesce(max(f.version), 0) FROM w f WHERE f.replaces AND f.version <= w.version)) AS BIGINT) AS rows_visible FROM w""")
def load_versions_orders(spark, root):
    """Appends and a replacement; what each version shows is still there to read."""
    path = scratch_dir(spark, "load-versions")
    orders, held = table(spark, root, "orders"), versioned.VersionedTable(path)
    for replaces, rest, by in VERSION_STEPS:
        held.write(orders.filter(F.col("o_orderkey") % by == rest), replace=replaces)
    shown = union_all(
        held.read(spark, v, orders.schema).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("rows_visible"))
        for v in range(len(VERSION_STEPS)))
    return held.history(spark).join(shown, "version").select("version", "replaces", "rows", "rows_visible")


EVENT_CHECKS = {"value is positive": "value > 0", "user is known": "user_id IS NOT NULL"}


@query("load_measures_events", with_variants("d_events") + " " + " UNION ALL ".join([
    "SELECT 'rows' AS measure, count(*) AS found FROM d_events",
    *[f"SELECT 'nulls:{c}', count(*) - count({'CASE WHEN NOT isnan(value) THEN value END' if c == 'value' else c}) FROM d_events"
      for c in ("event_id", "ts", "user_id", "event_type", "value", "props", "origin")],
    "SELECT 'failed:value is positive', count(*) FILTER (value IS NULL OR (value <= 0 AND NOT isnan(value))) FROM d_events",
    "SELECT 'failed:user is known', count(*) FILTER (user_id IS NULL) FROM d_events"]))
def load_measures_events(spark, root):
    """Rows, nulls and failed checks of a load, measured by the tasks that write it."""
    events = variant(spark, root, "d_events")
    found = measured.measured_write(events, scratch_dir(spark, "load-measures"), measured.table_measures(
        events.schema, {n: F.expr(c) for n, c in EVENT_CHECKS.items()}))
    return literal_rows(spark, "measure string, found long", list(found.items()))


@query("skip_processed", """
SELECT concat('f', doc_id, '.txt') AS file, sha256(text) AS digest FROM documents d
WHERE NOT (doc_id % 4 = 0) AND NOT (doc_id % 4 = 1 AND doc_id % 8 = 1)""")
def skip_processed(spark, root):
    files = table(spark, root, "documents").select(
        "doc_id", F.format_string("f%d.txt", "doc_id").alias("file"),
        F.sha2("text", 256).alias("digest"),
    )
    slot = F.col("doc_id") % 4
    history = files.filter(slot < 3).select(
        "file",
        F.when(slot == 2, "outdated").otherwise(F.col("digest")).alias("digest"),
        F.when((slot == 1) & (F.col("doc_id") % 8 != 1), "FAILED").otherwise("SUCCESS")
        .alias("status"),
    )
    return writers.unprocessed(files.select("file", "digest"), history)


# --- quarantine and history -------------------------------------------------------------
TYPES = {"o_custkey": "INTEGER", "o_totalprice": "NUMERIC", "o_orderday": "DATE"}

CHECKED = with_variants("s_orders_dirty") + """,
checked AS (SELECT *, nullif(concat_ws('; ',
    CASE WHEN o_totalprice = 'N/A' THEN 'o_totalprice: not NUMERIC' END,
    CASE WHEN o_orderday = '2023-02-30' THEN 'o_orderday: not DATE' END,
    CASE WHEN trim(o_custkey) = '' THEN 'o_custkey: missing' END), '') AS error
  FROM s_orders_dirty)"""


def checked(spark, root):
    return shape.quarantine(variant(spark, root, "s_orders_dirty"), TYPES, ["o_custkey"])


@query("quarantine_rows", CHECKED + """
SELECT o_orderkey, o_totalprice, o_orderday, error FROM checked WHERE error IS NOT NULL""")
def quarantine_rows(spark, root):
    return checked(spark, root).filter(F.col("error").isNotNull()).select(
        "o_orderkey", "o_totalprice", "o_orderday", "error"
    )


@query("typed_rows", CHECKED + """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) + 3000000000 AS o_custkey,
       concat(o_totalprice, printf('%04d', CAST(o_custkey AS BIGINT) % 10000)) AS price,
       CAST(o_orderday AS DATE) AS o_orderday FROM checked WHERE error IS NULL""")
def typed_rows(spark, root):
    good = checked(spark, root).filter(F.col("error").isNull())
    number = F.col("o_custkey").cast("bigint")  # keys beyond 32 bits, prices with six decimals
    good = good.withColumns({
        "o_custkey": (number + 3000000000).cast("string"),
        "o_totalprice": F.concat("o_totalprice", F.format_string("%04d", number % 10000)),
    })
    return shape.typed(good, {**TYPES, "o_orderkey": "BIGINT"}).select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(38,6)").cast("string").alias("price"),
        "o_orderday",
    )


@query("load_history", CHECKED + """
SELECT o_orderday AS file, '2026-01-01T00:00:00' AS "timestamp", 'orders' AS "table",
       CASE WHEN count(error) = 0 THEN count(*) ELSE 0 END AS rows_inserted,
       count(error) AS rows_rejected,
       CASE WHEN count(error) = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status
FROM checked GROUP BY o_orderday""")
def load_history(spark, root):
    path = scratch_dir(spark, "history")
    history = writers.load_history(
        checked(spark, root), "o_orderday", "orders", "2026-01-01T00:00:00"
    )
    writers.append_history(history, path)
    return spark.read.schema(history.schema).json(path)


# --- shape --------------------------------------------------------------------------------
@query("union_missing_cols", """
SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, NULL AS balance FROM orders
UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal FROM customer
UNION ALL SELECT s_suppkey, 'S', NULL, s_acctbal FROM supplier""")
def union_missing_cols(spark, root):
    o, c, s = (table(spark, root, t) for t in ("orders", "customer", "supplier"))
    return shape.union_columns([
        o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                 F.col("o_totalprice").alias("price")),
        c.select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id")),
        s.select(F.col("s_suppkey").alias("id"), F.lit("S").alias("status"),
                 F.col("s_acctbal").alias("balance")),
    ])


@query("align_to_target", """
SELECT p_partkey, p_size, p_name, CAST(NULL AS DOUBLE) AS p_cost, CAST(NULL AS VARCHAR) AS p_note
FROM part""")
def align_to_target(spark, root):
    target = [("p_partkey", "bigint"), ("p_cost", "double"), ("p_size", "int"),
              ("p_note", "string"), ("p_name", "string")]
    return shape.align_to(table(spark, root, "part"), target)


@query("evolve_add_columns", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment
FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT * FROM customer WHERE c_custkey % 2 = 1""")
def evolve_add_columns(spark, root):
    customer = table(spark, root, "customer")
    even = F.col("c_custkey") % 2 == 0
    return shape.evolve(variant(spark, root, "t_customer").filter(even), customer.filter(~even))


@query("view_sample_part", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
ORDER BY p_partkey LIMIT 10""")
def view_sample_part(spark, root):
    return shape.sample_view(table(spark, root, "part"), ["p_partkey"])


@query("sample_rows_100", """
SELECT * FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate,
         l_returnflag, l_discount LIMIT 100""")
def sample_rows_100(spark, root):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
             "l_shipdate", "l_returnflag", "l_discount"]
    return shape.sample_view(table(spark, root, "lineitem"), order, 100)


@query("mv_refresh_orders", "SELECT * FROM orders")
def mv_refresh_orders(spark, root):
    view = writers.MaterializedView(table(spark, root, "orders"), scratch_dir(spark, "mv"))
    view.refresh()
    return view.read()


@query("mv_refresh_nation", """
SELECT n_nationkey, n_name, n_regionkey, coalesce(c.n, 0) AS customers
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c
ON c.c_nationkey = n_nationkey""")
def mv_refresh_nation(spark, root):
    held = table(spark, root, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    source = table(spark, root, "nation").join(held, "n_nationkey", "left").select(
        "n_nationkey", "n_name", "n_regionkey",
        F.coalesce("n", F.lit(0)).cast("long").alias("customers"),
    )
    view = writers.MaterializedView(source, scratch_dir(spark, "mv-nation"))
    view.refresh()
    return view.read()


@query("stamp_created_at", """
SELECT event_id, user_id, TIMESTAMP '2026-01-01 00:00:00' AS created_at, 'always' AS policy
FROM events
UNION ALL
SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE ts END,
       'where null' FROM events""")
def stamp_created_at(spark, root):
    events = table(spark, root, "events").select(
        "event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("created_at")
    )
    now = F.expr("timestamp_ntz'2026-01-01 00:00:00'")
    return union_all([
        shape.stamped(events, now).withColumn("policy", F.lit("always")),
        shape.stamped(events, now, keep=True).withColumn("policy", F.lit("where null")),
    ])


@query("retention_split_events", """
SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY THEN 'KEEP'
       ELSE 'ARCHIVE' END AS with_archive,
       CASE WHEN ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY THEN 'KEEP'
       ELSE 'PURGE' END AS without_archive FROM events""")
def retention_split_events(spark, root):
    as_of = F.expr("timestamp_ntz'2024-01-31 00:00:00'")
    return table(spark, root, "events").select(
        "event_id",
        shape.retention_label(F.col("ts"), 10, True, as_of).alias("with_archive"),
        shape.retention_label(F.col("ts"), 20, False, as_of).alias("without_archive"),
    )


# --- requirements ---------------------------------------------------------------------------
REQUIREMENTS = """SELECT concat('db_', CAST(c_custkey AS STRING)) AS database,
CASE c_custkey % 5 WHEN 0 THEN '-3' WHEN 1 THEN '36x' WHEN 2 THEN NULL ELSE '365' END
  AS retention_days,
CASE c_custkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'true' ELSE 'false' END AS archive_required,
CASE c_custkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '60.5' ELSE '60' END AS max_duration_minutes,
CASE c_custkey % 7 WHEN 0 THEN '-1' WHEN 1 THEN '' ELSE '0' END AS max_downtime_minutes
FROM {customer}"""

BROKEN_NUMBER = """
SELECT database, '{c}' AS "column", CASE WHEN {c} IS NULL OR NOT regexp_full_match({c}, '-?[0-9]+')
  THEN 'NOT_AN_INTEGER' ELSE '{kind}' END AS issue_type,
  CASE WHEN {c} IS NULL OR NOT regexp_full_match({c}, '-?[0-9]+')
  THEN 'must be an integer' ELSE '{msg}' END AS message
FROM r WHERE {c} IS NULL OR NOT regexp_full_match({c}, '-?[0-9]+')
  OR TRY_CAST({c} AS BIGINT) {bad}"""


@query("validate_requirements", f"""WITH r AS (
{REQUIREMENTS.replace('STRING', 'VARCHAR').replace('{customer}', 'customer')})
{BROKEN_NUMBER.format(c='retention_days', kind='NEGATIVE_VALUE', msg='must not be negative',
                      bad='< 0')}
UNION ALL {BROKEN_NUMBER.format(c='max_duration_minutes', kind='NOT_POSITIVE',
                                msg='must be above zero', bad='<= 0')}
UNION ALL {BROKEN_NUMBER.format(c='max_downtime_minutes', kind='NEGATIVE_VALUE',
                                msg='must not be negative', bad='< 0')}
UNION ALL SELECT database, 'archive_required', 'NOT_A_BOOLEAN', 'must be true or false' FROM r
WHERE archive_required NOT IN ('true', 'false')""")
def validate_requirements(spark, root):
    rows = spark.sql(REQUIREMENTS, customer=table(spark, root, "customer"))
    return scoring.requirement_findings(rows).select("database", "column", "issue_type", "message")


# --- text forms ---------------------------------------------------------------------------------
@query("canonical_json_events", """
SELECT concat('{"a":"x","k":"', substr(props, 7, length(props) - 7), '","z":"', event_id % 3, '"}')
       AS canonical, count(*) AS documents FROM events GROUP BY 1""")
def canonical_json_events(spark, root):
    events = table(spark, root, "events")
    inner = F.expr("substr(props, 2, length(props) - 2)")  # the object without its braces
    z = F.col("event_id") % 3
    doc = F.when(
        F.col("event_id") % 2 == 0, F.format_string('{"z": %d, %s, "a": "x"}', z, inner)
    ).otherwise(F.format_string('{"a": "x", "z": %d, %s}', z, inner))
    return events.groupBy(tx.canonical_json_text(doc).alias("canonical")).agg(
        F.count(F.lit(1)).alias("documents")
    )


@query("json_export", """
SELECT o_orderkey, concat('{"o_orderkey":', o_orderkey, ',"o_custkey":', o_custkey,
       ',"o_orderstatus":"', o_orderstatus, '","o_totalprice":', o_totalprice, ',"o_orderdate":"',
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '","o_orderpriority":"', o_orderpriority, '"}') AS document
FROM orders""")
def json_export(spark, root):
    orders = table(spark, root, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderdate", "o_orderpriority",
    )
    return tx.json_safe(orders).select(
        "o_orderkey", F.to_json(F.struct("*")).alias("document")
    )


@query("format_durations", """
SELECT o_orderkey, CASE WHEN d < 60 THEN printf('%.2f seconds', d)
  WHEN floor(d / 60) < 60 THEN printf('%d min %.2f sec', CAST(floor(d / 60) AS BIGINT), d % 60)
  ELSE printf('%d hr %d min %.2f sec', CAST(floor(d / 3600) AS BIGINT),
              CAST(floor(d / 60) AS BIGINT) % 60, d % 60) END AS duration,
  CASE WHEN b < 1024 THEN printf('%.2f B', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024)
       ELSE printf('%.2f MB', b / 1048576) END AS size,
  format('{:,}', o_orderkey * 1009) AS number, printf('%.2f%%', p) AS percentage
FROM (SELECT o_orderkey, CAST(o_orderkey % 9000 AS DOUBLE) AS d,
             CAST(o_orderkey * 701 AS DOUBLE) AS b,
             CAST(o_custkey % 400 AS DOUBLE) / 4 AS p FROM orders) o""")
def format_durations(spark, root):
    orders = table(spark, root, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        tx.show_duration(key % 9000).alias("duration"),
        tx.show_bytes(key * 701).alias("size"),
        tx.show_number(key * 1009).alias("number"),
        tx.show_percentage((F.col("o_custkey") % 400).cast("double") / 4).alias("percentage"),
    )
