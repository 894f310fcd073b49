"""Reconciliation queries: datasets, orphans, changed keys, growth, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof.operators import digest_tree
from moveproof.operators import findings as fnd
from moveproof.operators import keys as k
from moveproof.operators import reconcile as rec
from moveproof.operators import snapshot as snap
from moveproof.operators.profile import union_all
from moveproof.plans.profiling import ISSUE_DATASETS, ISSUES_CTES, LAYOUT, profile_findings
from moveproof.plans.registry import query
from moveproof.plans.variants import Inputs, counts_sql, variant, with_variants
from moveproof.session import TABLES, scratch_dir, stored, table, tables
from moveproof.sources.catalog import (
    column_inventory, create_count_function, document_width, table_inventory,
)

# --- inventories ----------------------------------------------------------------
WIDTH = {t: len(LAYOUT[t]) for t in TABLES}

INVENTORY = " UNION ALL ".join(counts_sql(t, t, WIDTH[t]) for t in TABLES)


@query("discover_tables", f"""
SELECT 'source' AS database, dataset, 'TABLE' AS dataset_type, record_count, column_count
FROM ({INVENTORY}) x""")
def discover_tables(spark, root):
    return table_inventory(tables(spark, root))


SPARK_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "NUMERIC": "double", "TEXT": "string",
               "TIMESTAMP": "timestamp_ntz"}


def _inventory_rows():
    for t in TABLES:
        for i, (c, kind) in enumerate(LAYOUT[t]):
            name = "array<float>" if c == "embedding" else SPARK_NAMES[kind]
            yield (f"SELECT '{t}' AS dataset, {i} AS ordinal, '{c}' AS \"column\", "
                   f"'{name}' AS data_type, true AS nullable, count(\"{c}\") AS filled_rows FROM {t}")


@query("column_inventory", " UNION ALL ".join(_inventory_rows()))
def column_inventory_all(spark, root):
    frames = tables(spark, root)
    filled = union_all(
        df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).select(
            F.lit(name).alias("dataset"),
            F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))]))
            .alias("ordinal", "filled_rows"),
        )
        for name, df in frames.items()
    )
    return column_inventory(frames).join(filled, ["dataset", "ordinal"]).select(
        "dataset", "ordinal", "column", "data_type", "nullable", "filled_rows"
    )


@query("doc_field_count", """
SELECT event_type, count(DISTINCT k) AS field_count FROM (
  SELECT event_type, unnest(json_keys(doc)) AS k FROM (
    SELECT event_type, concat('{"_id": ', event_id, ', "u', user_id, '": 1, "v', event_id % 97,
                              '": 2, "props": ', props, '}') AS doc FROM events) d) e
WHERE k <> '_id' GROUP BY event_type""")
def doc_field_count(spark, root):
    events = table(spark, root, "events")
    doc = F.format_string('{"_id": %d, "u%d": 1, "v%d": 2, "props": %s}', "event_id", "user_id",
                          F.col("event_id") % 97, "props")
    return document_width(events.select("event_type", doc.alias("doc")), "doc", ["event_type"])


# --- reconcile --------------------------------------------------------------------
SOURCE = ("orders", "lineitem", "customer", "supplier", "part", "nation")
RECONCILED = (*SOURCE, "t_orders", "t_lineitem", "t_customer", "region")
TARGET = {"orders": "t_orders", "lineitem": "t_lineitem", "customer": "t_customer",
          "PART": "part", "nation": "nation", "legacy_region": "region"}


def reconciled(inputs):
    source = table_inventory(inputs.only(*SOURCE))
    target = table_inventory({n: inputs[v] for n, v in TARGET.items()})
    return rec.reconcile(source, target)


RECONCILE_CTES = with_variants("t_orders", "t_lineitem", "t_customer") + f""",
src AS ({" UNION ALL ".join(counts_sql(t, t, WIDTH[t]) for t in SOURCE)}),
tgt AS ({counts_sql("t_orders", "orders", 6)} UNION ALL {counts_sql("t_lineitem", "lineitem", 8)}
  UNION ALL {counts_sql("t_customer", "customer", 4)} UNION ALL {counts_sql("part", "PART", 6)}
  UNION ALL {counts_sql("nation", "nation", 3)}
  UNION ALL {counts_sql("region", "legacy_region", 2)}),
sides AS (
SELECT coalesce(s.dataset, t.dataset) AS dataset, s.record_count AS expected_rows,
       t.record_count AS actual_rows, s.column_count AS expected_columns,
       t.column_count AS actual_columns, s.dataset IS NULL AS extra, t.dataset IS NULL AS missing
FROM src s FULL OUTER JOIN tgt t ON lower(s.dataset) = lower(t.dataset)),
reconciled AS (
SELECT 'source' AS database, dataset, expected_rows, actual_rows,
       actual_rows - expected_rows AS row_difference,
       abs(actual_rows - expected_rows) AS absolute_row_difference,
       CASE WHEN missing OR extra THEN NULL WHEN expected_rows > 0 THEN
         round(100.0 * least(expected_rows, actual_rows) / greatest(expected_rows, actual_rows), 2)
         WHEN actual_rows = 0 THEN 100.0 ELSE 0.0 END AS match_percentage,
       expected_columns, actual_columns, actual_columns - expected_columns AS column_difference,
       CASE WHEN missing THEN 'MISSING_TARGET_DATASET' WHEN extra THEN 'EXTRA_TARGET_DATASET'
            WHEN expected_rows = actual_rows AND expected_columns = actual_columns
            THEN 'RECONCILED' ELSE 'NOT_RECONCILED' END AS status
FROM sides),
recon_issues AS (
SELECT database, dataset, status AS issue_type,
       CASE WHEN status = 'EXTRA_TARGET_DATASET' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
       CAST(expected_rows AS DOUBLE) AS expected, CAST(actual_rows AS DOUBLE) AS actual,
       concat(dataset, CASE WHEN status = 'EXTRA_TARGET_DATASET' THEN ' has no source dataset'
                            ELSE ' is not in the target' END) AS message, 0 AS position
FROM reconciled WHERE status IN ('MISSING_TARGET_DATASET', 'EXTRA_TARGET_DATASET')
UNION ALL
SELECT database, dataset, 'ROW_COUNT_MISMATCH',
       CASE WHEN match_percentage < 90 THEN 'HIGH' WHEN match_percentage < 99 THEN 'MEDIUM'
            ELSE 'LOW' END, expected_rows, actual_rows,
       concat(dataset, ': ', expected_rows, ' rows expected, ', actual_rows, ' found'), 0
FROM reconciled WHERE status = 'NOT_RECONCILED' AND row_difference <> 0
UNION ALL
SELECT database, dataset,
       CASE WHEN abs(column_difference) <= 2 THEN 'COLUMN_COUNT_MISMATCH_MINOR'
            ELSE 'COLUMN_COUNT_MISMATCH' END,
       CASE WHEN abs(column_difference) <= 2 THEN 'MEDIUM' ELSE 'HIGH' END,
       expected_columns, actual_columns,
       concat(dataset, ': ', expected_columns, ' columns expected, ', actual_columns, ' found'), 1
FROM reconciled WHERE status = 'NOT_RECONCILED' AND column_difference <> 0)
"""


@query("reconcile_datasets", RECONCILE_CTES + "SELECT * FROM reconciled")
def reconcile_datasets(spark, root):
    return reconciled(Inputs(spark, root, *RECONCILED))


@query("reconcile_issues", RECONCILE_CTES + """
SELECT database, dataset, issue_type, severity, expected, actual, message, position
FROM recon_issues""")
def reconcile_issues(spark, root):
    return rec.reconciliation_issues(reconciled(Inputs(spark, root, *RECONCILED))).select(
        "database", "dataset", "issue_type", "severity", "expected", "actual", "message", "position"
    )


SUMMARY_SQL = """
SELECT r.database, r.expected_datasets, r.target_datasets, r.reconciled_datasets,
       r.not_reconciled_datasets, r.missing_target_datasets, r.extra_target_datasets,
       i.total_issues, i.high_severity_issues, i.medium_severity_issues, i.low_severity_issues,
       'EXECUTED' AS reconciliation_status
FROM (SELECT database, count(*) FILTER (WHERE status <> 'EXTRA_TARGET_DATASET') AS expected_datasets,
             count(*) FILTER (WHERE status <> 'MISSING_TARGET_DATASET') AS target_datasets,
             count(*) FILTER (WHERE status = 'RECONCILED') AS reconciled_datasets,
             count(*) FILTER (WHERE status IN ('MISSING_TARGET_DATASET', 'NOT_RECONCILED'))
               AS not_reconciled_datasets,
             count(*) FILTER (WHERE status = 'MISSING_TARGET_DATASET') AS missing_target_datasets,
             count(*) FILTER (WHERE status = 'EXTRA_TARGET_DATASET') AS extra_target_datasets
      FROM reconciled GROUP BY database) r
JOIN (SELECT database, count(*) AS total_issues,
             count(*) FILTER (WHERE severity = 'HIGH') AS high_severity_issues,
             count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_severity_issues,
             count(*) FILTER (WHERE severity = 'LOW') AS low_severity_issues
      FROM recon_issues GROUP BY database) i ON i.database = r.database
"""


@query("reconcile_summary", RECONCILE_CTES + SUMMARY_SQL)
def reconcile_summary(spark, root):
    sides = stored(reconciled(Inputs(spark, root, *RECONCILED)), "reconciled")
    return rec.reconciliation_summary(sides, rec.reconciliation_issues(sides))


@query("reconcile_not_executed", f"""
SELECT 'source' AS database, count(*) AS expected_datasets, CAST(0 AS BIGINT) AS target_datasets,
  CAST(0 AS BIGINT) AS reconciled_datasets, CAST(0 AS BIGINT) AS not_reconciled_datasets,
  CAST(0 AS BIGINT) AS missing_target_datasets, CAST(0 AS BIGINT) AS extra_target_datasets,
  CAST(0 AS BIGINT) AS total_issues, CAST(0 AS BIGINT) AS high_severity_issues,
  CAST(0 AS BIGINT) AS medium_severity_issues, CAST(0 AS BIGINT) AS low_severity_issues,
  'NOT_EXECUTED_DATABASE_REQUIRED' AS reconciliation_status
FROM ({" UNION ALL ".join(counts_sql(t, t, WIDTH[t]) for t in SOURCE)}) s""")
def reconcile_not_executed(spark, root):
    source = table_inventory(tables(spark, root, SOURCE))
    sides = rec.reconcile(source, source.limit(0))
    return rec.reconciliation_summary(sides, rec.reconciliation_issues(sides), executed=False)


@query("count_functions", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS record_count FROM {t}"
    for t in ("orders", "lineitem", "events")))
def count_functions(spark, root):
    names = {t: create_count_function(spark, t, table(spark, root, t))
             for t in ("orders", "lineitem", "events")}
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{t}' AS `table`, {f}() AS record_count" for t, f in names.items()
    ))


# --- orphans ------------------------------------------------------------------------
def relation(inputs, child, child_key, parent, parent_key):
    return {
        "name": f"{child}.{child_key} -> {parent}.{parent_key}", "child_name": child,
        "child": inputs[child], "child_key": child_key,
        "parent": inputs[parent], "parent_key": parent_key,
    }


RELATIONS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("d_orders_fk", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_orderkey", "t_orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


def orphan_sql(child, child_key, parent, parent_key):
    lost = (f"FROM {child} c WHERE {child_key} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{child_key})")
    return (f"SELECT '{child}.{child_key} -> {parent}.{parent_key}' AS relation, "
            f"(SELECT count(*) {lost}) AS orphan_rows, "
            f"(SELECT count(DISTINCT {child_key}) {lost}) AS orphan_keys")


ORPHANS_ALL = (
    with_variants("d_orders_fk", "t_orders") + " " + " UNION ALL ".join(
        orphan_sql(*r) for r in RELATIONS)
)


@query("fk_orphans_orders", with_variants("d_orders_fk") + " " + orphan_sql(*RELATIONS[1]))
def fk_orphans_orders(spark, root):
    inputs = Inputs(spark, root, "d_orders_fk", "customer")
    return k.fk_orphans([relation(inputs, *RELATIONS[1])])


@query("fk_orphans_all", ORPHANS_ALL)
def fk_orphans_all(spark, root):
    names = {n for child, _, parent, _ in RELATIONS for n in (child, parent)}
    inputs = Inputs(spark, root, *sorted(names))
    return k.fk_orphans([relation(inputs, *r) for r in RELATIONS])


NULLKEY = ("d_orders_fk", "o_custkey", "d_customer_nullkey", "c_custkey")


@query("fk_orphans_not_in", with_variants("d_orders_fk", "d_customer_nullkey") + """
SELECT 'd_orders_fk.o_custkey -> d_customer_nullkey.c_custkey' AS relation,
       count(*) AS orphan_rows, count(DISTINCT o_custkey) AS orphan_keys FROM d_orders_fk
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM d_customer_nullkey)
UNION ALL
SELECT 'd_orders_fk.o_custkey -> customer.c_custkey', count(*), count(DISTINCT o_custkey)
FROM d_orders_fk
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def fk_orphans_not_in(spark, root):
    inputs = Inputs(spark, root, "d_orders_fk", "d_customer_nullkey")
    return k.fk_orphans(
        [relation(inputs, *NULLKEY), relation(inputs, *RELATIONS[1])], null_aware=True
    )


# --- all findings ---------------------------------------------------------------------
FINDING_VIEW = ("database", "dataset", "column", "source", "issue_type", "severity",
                "affected_records", "affected_percentage", "expected", "actual", "message")

FINDING_RELATIONS = (RELATIONS[1], RELATIONS[3])


FINDING_INPUTS = (*ISSUE_DATASETS, *RECONCILED, "d_orders_fk", "t_orders")


def findings(inputs, duplicates=None, sides=None):
    """Profile, key, reconciliation and orphan findings in one layout."""
    relations = [relation(inputs, *r) for r in FINDING_RELATIONS]
    return union_all([
        profile_findings(inputs, duplicates),
        rec.reconciliation_issues(reconciled(inputs) if sides is None else sides),
        k.orphan_findings(k.fk_orphans(relations), relations),
    ])


FINDINGS_CTES = ISSUES_CTES + "," + RECONCILE_CTES[len("WITH "):] + f""",
{with_variants("d_orders_fk")[len("WITH "):]},
orphans AS ({" UNION ALL ".join(
    orphan_sql(*r) + f", '{r[0]}' AS child, '{r[1]}' AS child_key" for r in FINDING_RELATIONS)}),
all_findings AS (
SELECT database, dataset, "column", 'PROFILING' AS source, issue_type, severity, affected_records,
       affected_percentage, CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS actual,
       message, position FROM profile_issues
UNION ALL
SELECT database, dataset, NULL, 'RECONCILIATION', issue_type, severity, NULL, NULL, expected, actual,
       message, position FROM recon_issues
UNION ALL
SELECT 'source', child, child_key, 'FOREIGN_KEY', 'FOREIGN_KEY_ORPHAN', 'HIGH', orphan_rows, NULL,
       NULL, NULL, concat(relation, ' has ', orphan_rows, ' orphan rows'), -1
FROM orphans WHERE orphan_rows > 0)
"""


@query("all_findings", FINDINGS_CTES + f"""
SELECT {", ".join('"column"' if c == "column" else c for c in FINDING_VIEW)} FROM all_findings""")
def all_findings(spark, root):
    return findings(Inputs(spark, root, *FINDING_INPUTS)).select(*FINDING_VIEW)


# --- changed keys -------------------------------------------------------------------------
@query("snapshot_diff_customer", with_variants("p_customer") + """
SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey,
       CASE WHEN p.c_custkey IS NULL THEN 'NEW' WHEN c.c_custkey IS NULL THEN 'DELETED'
            WHEN c.c_name = p.c_name AND c.c_nationkey = p.c_nationkey
                 AND c.c_acctbal = p.c_acctbal AND c.c_mktsegment = p.c_mktsegment
            THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_status,
       CAST(CASE WHEN p.c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rows_before,
       CAST(CASE WHEN c.c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rows_now
FROM customer c FULL OUTER JOIN p_customer p ON c.c_custkey = p.c_custkey""")
def snapshot_diff_customer(spark, root):
    return snap.change_status(
        variant(spark, root, "p_customer"), table(spark, root, "customer"), ["c_custkey"]
    )


LINE_KEY = "l_orderkey"
LINE_REST = ", ".join(c for c in (
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate"))


@query("snapshot_diff_repeated_keys", f"""
WITH prev AS (SELECT l_orderkey, {LINE_REST} FROM lineitem WHERE l_orderkey % 9 <> 0),
cur AS (SELECT * REPLACE (CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END
                          AS l_quantity)
        FROM (SELECT l_orderkey, {LINE_REST} FROM lineitem WHERE l_orderkey % 8 <> 0)),
folded AS (SELECT l_orderkey, sum(b) AS b, sum(n) AS n FROM (
    SELECT *, 1 AS b, 0 AS n FROM prev UNION ALL SELECT *, 0, 1 FROM cur)
  GROUP BY l_orderkey, {LINE_REST}),
keys AS (SELECT l_orderkey, bool_and(b = n) AS same, CAST(sum(b) AS BIGINT) AS rows_before,
                CAST(sum(n) AS BIGINT) AS rows_now FROM folded GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN rows_before = 0 THEN 'NEW' WHEN rows_now = 0 THEN 'DELETED'
       WHEN same THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_status, rows_before, rows_now FROM keys""")
def snapshot_diff_repeated_keys(spark, root):
    line = table(spark, root, "lineitem")
    raised = F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(
        F.col("l_quantity")
    )
    return snap.change_status(
        line.filter(F.col("l_orderkey") % 9 != 0),
        line.filter(F.col("l_orderkey") % 8 != 0).withColumn("l_quantity", raised),
        ["l_orderkey"],
    )


@query("snapshot_diff_layouts", """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS change_status,
       1::BIGINT AS rows_before, 1::BIGINT AS rows_now FROM customer""")
def snapshot_diff_layouts(spark, root):
    """The same rows with columns in another order, narrower, and one column that is new."""
    customer = table(spark, root, "customer")
    before = customer.select(
        "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_name",
        "c_custkey")
    note = F.when(F.col("c_custkey") % 6 == 0, "checked")
    return snap.change_status(before, customer.withColumn("note", note), ["c_custkey"])


# orders a day later: some prices raised, some orders gone, some new
LATER_ORDERS = """SELECT * REPLACE (CASE WHEN o_orderkey % 499 = 0 THEN o_totalprice + 1 ELSE o_totalprice END
  AS o_totalprice) FROM orders WHERE o_orderkey % 1009 <> 0
UNION ALL SELECT * REPLACE (o_orderkey + 1000000000 AS o_orderkey) FROM orders WHERE o_orderkey % 2003 = 0"""


def later_orders(orders):
    key = F.col("o_orderkey")
    raised = F.when(key % 499 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.filter(key % 1009 != 0).withColumn("o_totalprice", raised).unionByName(
        orders.filter(key % 2003 == 0).withColumn("o_orderkey", key + 1000000000))


@query("digest_tree_orders", f"""WITH later AS ({LATER_ORDERS})
SELECT coalesce(c.o_orderkey, p.o_orderkey) AS o_orderkey,
       CASE WHEN p.o_orderkey IS NULL THEN 'NEW' WHEN c.o_orderkey IS NULL THEN 'DELETED' ELSE 'CHANGED' END
       AS change_status, CAST(p.o_orderkey IS NOT NULL AS BIGINT) AS rows_before,
       CAST(c.o_orderkey IS NOT NULL AS BIGINT) AS rows_now
FROM later c FULL OUTER JOIN orders p ON c.o_orderkey = p.o_orderkey
WHERE p.o_orderkey IS NULL OR c.o_orderkey IS NULL OR c.o_totalprice <> p.o_totalprice""")
def digest_tree_orders(spark, root):
    """Two written snapshots, compared by their trees; only leaves that differ are read."""
    orders = table(spark, root, "orders")
    before, after = scratch_dir(spark, "before"), scratch_dir(spark, "after")
    digest_tree.write_snapshot(orders, ["o_orderkey"], before)
    digest_tree.write_snapshot(later_orders(orders), ["o_orderkey"], after)
    return digest_tree.changed_keys(spark, before, after, orders.select("o_orderkey").schema)


def digest_sql(columns) -> str:
    parts = ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"md5(concat_ws('|', {parts}))"


DIGESTED = {"customer": ("c_custkey", ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"]),
            "labels": ("doc_id", ["doc_id", "quality", "toxic"]),
            "conversations": ("conv_id", ["conv_id", "role", "text", "turn"])}
DIGEST_TREE_SQL = "WITH rows_ AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, ('0x' || substr({digest_sql([key])}, 1, 4))::BIGINT AS leaf, {digest_sql(columns)} AS d FROM {t}"
    for t, (key, columns) in DIGESTED.items()) + """),
levels AS (SELECT unnest(range(0, 5))::INTEGER AS level)
SELECT dataset, level, (leaf >> (16 - 4 * level))::INTEGER AS node, count(*) AS n_rows,
  """ + ", ".join(f"CAST(sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT) AS BIGINT) AS s{i}" for i in range(4)) + """
FROM rows_, levels GROUP BY ALL"""


@query("digest_tree_nodes", DIGEST_TREE_SQL)
def digest_tree_nodes(spark, root):
    return union_all(
        digest_tree.digest_tree(table(spark, root, t), [key]).withColumn("dataset", F.lit(t))
        for t, (key, _) in DIGESTED.items())


FINGERPRINT_SQL = " UNION ALL ".join(f"""
SELECT '{name}' AS dataset, CAST(substr(d, 1, 1) AS VARCHAR) AS bucket, count(*) AS row_count,
  CAST(sum(('0x' || substr(d, 2, 8))::BIGINT) AS BIGINT) AS fingerprint
FROM (SELECT md5(concat_ws('|', {", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)})) AS d
      FROM {name}) x GROUP BY 1, 2""" for name, columns in (
    ("nation", ("n_nationkey", "n_name", "n_regionkey")),
    ("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    ("documents", ("doc_id", "text", "lang", "source", "n_chars")),
    ("pages", ("page_id", "url", "html"))))


@query("table_buckets", FINGERPRINT_SQL)
def table_buckets(spark, root):
    return union_all(
        snap.bucket_fingerprints(df.select(*columns), name) for name, df, columns in (
            (n, table(spark, root, n), c) for n, c in (
                ("nation", ("n_nationkey", "n_name", "n_regionkey")),
                ("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
                ("documents", ("doc_id", "text", "lang", "source", "n_chars")),
                ("pages", ("page_id", "url", "html")))))


@query("table_fingerprint")
def table_fingerprint(spark, root):
    return union_all(
        snap.table_fingerprint(df, name) for name, df in tables(spark, root).items()
    )


# --- growth and discovery ---------------------------------------------------------------------
# two snapshots: one database per nation, one dataset per market segment / priority class
SNAPSHOTS = """WITH cur AS (
SELECT concat('nation_', c_nationkey) AS database, c_mktsegment AS dataset, count(*) AS record_count
FROM customer WHERE c_custkey % 10 <> 3 AND NOT (c_mktsegment = 'MACHINERY' AND c_nationkey % 4 = 0)
GROUP BY c_nationkey, c_mktsegment),
prev AS (
SELECT concat('nation_', c_nationkey) AS database, c_mktsegment AS dataset, count(*) AS record_count
FROM customer WHERE c_custkey % (7 + c_nationkey % 3) <> 2
  AND NOT (c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0) AND c_nationkey % 5 <> 0
GROUP BY c_nationkey, c_mktsegment)"""

GROWTH = SNAPSHOTS + """,
growth AS (
SELECT coalesce(p.database, c.database) AS database, coalesce(p.dataset, c.dataset) AS dataset,
       CASE WHEN p.dataset IS NULL THEN 'NEW_DATASET' WHEN c.dataset IS NULL THEN 'REMOVED_DATASET'
            WHEN c.record_count > p.record_count THEN 'GROWTH'
            WHEN c.record_count < p.record_count THEN 'REDUCTION' ELSE 'NO_CHANGE' END AS status,
       coalesce(p.record_count, 0) AS previous_record_count,
       coalesce(c.record_count, 0) AS current_record_count,
       coalesce(c.record_count, 0) - coalesce(p.record_count, 0) AS record_growth,
       CASE WHEN p.dataset IS NULL THEN NULL WHEN c.dataset IS NULL THEN -100.0
            ELSE round(100.0 * (c.record_count - p.record_count) / p.record_count, 2) END
         AS growth_rate_percent
FROM prev p FULL OUTER JOIN cur c ON p.database = c.database AND p.dataset = c.dataset)"""


def snapshots(spark, root):
    customer = table(spark, root, "customer")
    key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    current = customer.filter((key % 10 != 3) & ~((segment == "MACHINERY") & (nation % 4 == 0)))
    previous = customer.filter(
        (key % (7 + nation % 3) != 2) & ~((segment == "BUILDING") & (nation % 3 == 0))
        & (nation % 5 != 0)
    )
    return tuple(
        df.groupBy(
            F.format_string("nation_%d", nation).alias("database"), segment.alias("dataset")
        ).agg(F.count(F.lit(1)).alias("record_count"))
        for df in (previous, current)
    )


@query("growth_by_dataset", GROWTH + " SELECT * FROM growth")
def growth_by_dataset(spark, root):
    return snap.dataset_growth(*snapshots(spark, root))


@query("growth_summary", GROWTH + """
SELECT database, CASE WHEN known THEN 'ANALYZED' ELSE 'BASELINE_CREATED' END AS growth_status,
       CASE WHEN known THEN p END AS previous_total_records, c AS current_total_records,
       CASE WHEN known THEN c - p END AS total_record_growth,
       CASE WHEN known AND p <> 0 THEN round(100.0 * (c - p) / p, 2) END
         AS overall_growth_rate_percent,
       datasets_with_growth, datasets_with_reduction, datasets_without_change,
       CASE WHEN known THEN new_datasets ELSE 0 END AS new_datasets, removed_datasets
FROM (SELECT database, count(*) FILTER (WHERE status <> 'NEW_DATASET') > 0 AS known,
             CAST(sum(previous_record_count) AS BIGINT) AS p,
             CAST(sum(current_record_count) AS BIGINT) AS c,
             count(*) FILTER (WHERE status = 'GROWTH') AS datasets_with_growth,
             count(*) FILTER (WHERE status = 'REDUCTION') AS datasets_with_reduction,
             count(*) FILTER (WHERE status = 'NO_CHANGE') AS datasets_without_change,
             count(*) FILTER (WHERE status = 'NEW_DATASET') AS new_datasets,
             count(*) FILTER (WHERE status = 'REMOVED_DATASET') AS removed_datasets
      FROM growth GROUP BY database) g""")
def growth_summary(spark, root):
    previous, current = snapshots(spark, root)
    return snap.growth_summary(snap.dataset_growth(previous, current))


@query("discovery_summary", f"""
SELECT 'source' AS database, count(*) AS total_datasets,
       CAST(sum(record_count) AS BIGINT) AS total_records FROM ({INVENTORY}) x""")
def discovery_summary(spark, root):
    return snap.discovery_summary(table_inventory(tables(spark, root)))


@query("largest_datasets", SNAPSHOTS + """
SELECT database, dataset, record_count FROM cur ORDER BY record_count DESC, database, dataset LIMIT 10
""")
def largest_datasets(spark, root):
    return snap.largest_datasets(snapshots(spark, root)[1])


# --- registered tables and contracts --------------------------------------------------------------
@query("validate_loaded", """
SELECT r.name AS "table", CASE WHEN a.n IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status,
       coalesce(a.n, 0) AS record_count
FROM (SELECT DISTINCT concat('type_', lower(p_type), '_', p_size) AS name FROM part
      UNION SELECT concat('type_', p_partkey, '_x') FROM part WHERE p_partkey % 50 = 0) r
LEFT JOIN (SELECT concat('TYPE_', upper(p_type), '_', p_size) AS name, count(*) AS n FROM part
           WHERE p_size % 6 <> 0 GROUP BY p_type, p_size) a ON lower(a.name) = lower(r.name)""")
def validate_loaded(spark, root):
    part = table(spark, root, "part")
    registered = part.select(
        F.format_string("type_%s_%d", F.lower("p_type"), "p_size").alias("table")
    ).unionByName(
        part.filter(F.col("p_partkey") % 50 == 0).select(
            F.format_string("type_%d_x", "p_partkey").alias("table"))
    ).distinct()
    present = part.filter(F.col("p_size") % 6 != 0).groupBy(
        F.format_string("TYPE_%s_%d", F.upper("p_type"), "p_size").alias("dataset")
    ).agg(F.count(F.lit(1)).alias("record_count"))
    return rec.presence(registered, present)
