"""Schema drift queries over registries observed in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof.operators import drift, inclusion
from moveproof.operators import history as hist
from moveproof.plans.naming import USABLE, physical_sql
from moveproof.plans.registry import query
from moveproof.plans.variants import Inputs, variant, with_variants
from moveproof.session import literal_rows, table

REGISTRIES = with_variants("registry_prev", "registry_cur")


@query("schema_drift", REGISTRIES + """,
o AS (SELECT DISTINCT "table" AS t, lower("column") AS c FROM registry_prev),
n AS (SELECT DISTINCT "table" AS t, lower("column") AS c FROM registry_cur),
added AS (SELECT * FROM n EXCEPT SELECT * FROM o),
gone AS (SELECT * FROM o EXCEPT SELECT * FROM n)
SELECT x.t AS "table",
  CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.t = x.t) THEN 'NEW'
       WHEN EXISTS (SELECT 1 FROM added a WHERE a.t = x.t) THEN 'CHANGED'
       WHEN EXISTS (SELECT 1 FROM gone g WHERE g.t = x.t) THEN 'DELETED' ELSE 'UNCHANGED' END
    AS status,
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM added a WHERE a.t = x.t), '') AS added_columns,
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM gone g WHERE g.t = x.t), '') AS deleted_columns
FROM (SELECT DISTINCT t FROM n) x""")
def schema_drift(spark, root):
    return drift.schema_drift(
        variant(spark, root, "registry_prev"), variant(spark, root, "registry_cur")
    )


@query("schema_diff", REGISTRIES + """,
o AS (SELECT "table" AS t, list("column" ORDER BY ordinal) AS l FROM registry_prev GROUP BY "table"),
n AS (SELECT "table" AS t, list("column" ORDER BY ordinal) AS l FROM registry_cur GROUP BY "table")
SELECT n.t AS "table",
  array_to_string(list_filter(n.l, lambda x: NOT list_contains(coalesce(o.l, []), x)), ',')
    AS new_columns,
  array_to_string(list_filter(coalesce(o.l, []), lambda x: NOT list_contains(n.l, x)), ',')
    AS removed_columns,
  array_to_string(list_filter(n.l, lambda x: list_contains(coalesce(o.l, []), x)), ',')
    AS existing_columns
FROM n LEFT JOIN o ON o.t = n.t""")
def schema_diff(spark, root):
    return drift.schema_diff(
        variant(spark, root, "registry_prev"), variant(spark, root, "registry_cur")
    )


@query("registry_merge", REGISTRIES + """,
seen AS (SELECT "table", 0 AS source, ordinal, "column" FROM registry_prev
         UNION ALL SELECT "table", 1, ordinal, "column" FROM registry_cur),
first AS (SELECT *, row_number() OVER (PARTITION BY "table", lower("column")
          ORDER BY source, ordinal) AS rn FROM seen)
SELECT "table", CAST(row_number() OVER (PARTITION BY "table" ORDER BY source, ordinal) - 1 AS INTEGER)
       AS ordinal, "column" FROM first WHERE rn = 1""")
def registry_merge(spark, root):
    return drift.registry_merge(
        variant(spark, root, "registry_prev"), variant(spark, root, "registry_cur")
    )


@query("schema_audit", REGISTRIES + """
SELECT DISTINCT "table", NULL AS "column", 'ADD_TABLE' AS action, NULL AS storage_type,
       '2026-01-01T00:00:00' AS audit_ts FROM registry_cur c
WHERE NOT EXISTS (SELECT 1 FROM registry_prev p WHERE p."table" = c."table")
UNION ALL
SELECT DISTINCT "table", "column", 'ADD_COLUMN', 'VARCHAR(255)', '2026-01-01T00:00:00'
FROM registry_cur c
WHERE NOT EXISTS (SELECT 1 FROM registry_prev p
                  WHERE p."table" = c."table" AND p."column" = c."column")""")
def schema_audit(spark, root):
    return drift.schema_audit(
        variant(spark, root, "registry_prev"), variant(spark, root, "registry_cur"),
        "2026-01-01T00:00:00",
    )


LOG = """SELECT concat('t', CAST(o_custkey AS STRING)) AS "table", o_orderkey, o_orderdate,
       CAST(o_orderdate AS DATE) AS chunk,
       concat('id', CASE WHEN o_totalprice > 250000 THEN ',amount' ELSE '' END,
              CASE WHEN o_orderstatus = 'F' THEN ',closed_at' ELSE '' END) AS "columns"
FROM {orders}"""


@query("schema_versions", f"""WITH log AS (
{LOG.replace('STRING', 'VARCHAR').replace('{orders}', 'orders')}),
marked AS (SELECT *, CASE WHEN lag("columns") OVER w IS NULL OR lag("columns") OVER w <> "columns"
                     THEN 1 ELSE 0 END AS changed
           FROM log WINDOW w AS (PARTITION BY "table" ORDER BY o_orderdate, o_orderkey))
SELECT "table", o_orderkey, "columns", changed = 1 AS is_new_version,
       CAST(sum(changed) OVER (PARTITION BY "table" ORDER BY o_orderdate, o_orderkey
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM marked""")
def schema_versions(spark, root):
    log = spark.sql(LOG.replace('"', "`"), orders=table(spark, root, "orders"))
    return drift.schema_versions(log, "chunk", ["o_orderdate", "o_orderkey"]).select(
        "table", "o_orderkey", "columns", "is_new_version", "version"
    )


@query("table_source_map", """
SELECT concat('t', o_custkey) AS "table",
       arg_max(concat('file_', o_orderkey, '.csv'), (o_orderdate, o_orderkey)) AS source_file
FROM orders GROUP BY o_custkey""")
def table_source_map(spark, root):
    seen = table(spark, root, "orders").select(
        F.format_string("t%d", "o_custkey").alias("table"), "o_orderdate", "o_orderkey",
        F.format_string("file_%d.csv", "o_orderkey").alias("source_file"),
    )
    return drift.latest_per_key(seen, ["table"], ["o_orderdate", "o_orderkey"]).select(
        "table", "source_file"
    )


COVERED = """SELECT "table", "column" FROM type_registry
WHERE CAST(substr("column", 2) AS BIGINT) % 3 <> 0 AND "table" NOT IN ('Brand#3', 'Brand#7')"""

PLAN = with_variants("type_registry") + f""",
covered AS ({COVERED}),
plan AS (SELECT r."table", r."column",
  CASE WHEN EXISTS (SELECT 1 FROM covered c WHERE c."table" = r."table") THEN 'ADD_COLUMN'
       ELSE 'CREATE_TABLE' END AS action,
  coalesce({USABLE.format('selected_type')}, {USABLE.format('detected_type')}, 'TEXT')
    AS logical_type
FROM type_registry r WHERE NOT EXISTS (SELECT 1 FROM covered c
     WHERE c."table" = r."table" AND c."column" = r."column"))"""


def planned(spark, root):
    registry = variant(spark, root, "type_registry").withColumn("database", F.lit("source"))
    covered = registry.filter(
        (F.substring("column", 2, 20).cast("bigint") % 3 != 0)
        & ~F.col("table").isin("Brand#3", "Brand#7")
    )
    return drift.evolution_plan(registry, covered, "POSTGRESQL")


@query("evolution_plan", PLAN + f"""
SELECT 'source' AS database, "table", "column", action, logical_type,
       {physical_sql("POSTGRESQL")} AS physical_type FROM plan""")
def evolution_plan(spark, root):
    return planned(spark, root)


@query("schema_changed", PLAN + """
SELECT d.database, coalesce(p.n, 0) AS planned_changes, coalesce(p.n, 0) > 0 AS schema_changed
FROM (SELECT DISTINCT "table" AS database FROM type_registry
      UNION SELECT concat(n_name, '_db') FROM nation) d
LEFT JOIN (SELECT "table", count(*) AS n FROM plan GROUP BY "table") p ON p."table" = d.database""")
def schema_changed(spark, root):
    databases = (
        variant(spark, root, "type_registry").select(F.col("table").alias("database"))
        .union(table(spark, root, "nation").select(F.concat("n_name", F.lit("_db")))).distinct()
    )
    per_brand = planned(spark, root).withColumn("database", F.col("table"))
    return drift.changed_databases(per_brand, databases)


@query("contract_missing_columns", REGISTRIES + """,
filled AS (SELECT DISTINCT "table" FROM registry_cur)
SELECT DISTINCT "table", NULL AS "column", 'EMPTY_FILE' AS problem FROM registry_prev
WHERE "table" NOT IN (SELECT "table" FROM filled)
UNION ALL
SELECT "table", "column", 'MISSING_COLUMN' FROM registry_prev p
WHERE "table" IN (SELECT "table" FROM filled) AND NOT EXISTS (
  SELECT 1 FROM registry_cur c WHERE c."table" = p."table"
  AND lower(c."column") = lower(p."column"))""")
def contract_missing_columns(spark, root):
    present = variant(spark, root, "registry_cur")
    counts = present.groupBy("table").agg(F.count(F.lit(1)).alias("record_count"))
    return drift.contract_breaches(variant(spark, root, "registry_prev"), present, counts)


@query("expected_objects", """WITH e AS (
SELECT DISTINCT p_type AS object_type, lower(concat(p_brand, '_', p_name)) AS name,
       CASE WHEN p_size % 4 = 0 THEN 'custom' ELSE 'generated' END AS origin FROM part),
a AS (SELECT DISTINCT p_type AS object_type, lower(concat(p_brand, '_', p_name)) AS name FROM part
      WHERE p_partkey % 5 <> 0 OR p_type = 'SMALL'),
c AS (SELECT e.*, a.name IS NULL AS lost FROM e LEFT JOIN a
      ON a.object_type = e.object_type AND a.name = e.name)
SELECT object_type, count(DISTINCT name) AS expected_objects,
       count(DISTINCT name) FILTER (WHERE lost) AS missing_objects,
       count(*) FILTER (WHERE lost AND origin = 'generated') AS missing_generated,
       count(*) FILTER (WHERE lost AND origin = 'custom') AS missing_custom,
       CASE WHEN count(*) FILTER (WHERE lost) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM c GROUP BY object_type""")
def expected_objects(spark, root):
    part = table(spark, root, "part")
    name = F.concat_ws("_", "p_brand", "p_name")
    expected = part.select(
        F.col("p_type").alias("object_type"), name.alias("name"),
        F.when(F.col("p_size") % 4 == 0, "custom").otherwise("generated").alias("origin"),
    )
    actual = part.filter((F.col("p_partkey") % 5 != 0) | (F.col("p_type") == "SMALL")).select(
        F.col("p_type").alias("object_type"), F.upper(name).alias("name")
    )
    return hist.expected_objects(expected, actual)


# --- renames ------------------------------------------------------------------------------
#: Per table the columns that vanish and those that appear, with their families.
RENAMED = {
    "orders": ([("o_custkey", "whole"), ("o_orderstatus", "text"), ("o_totalprice", "real"), ("o_orderpriority", "text")],
               [("customer_ref", "whole"), ("amount", "real"), ("prio", "text"), ("state", "text")]),
    "customer": ([("c_custkey", "whole"), ("c_name", "text"), ("c_acctbal", "real")],
                 [("id", "whole"), ("full_name", "text"), ("balance", "real"), ("same_name", "text")]),
}
PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS t, '{old}' AS old, '{new}' AS new, {i} AS i, {j} AS j,
  (SELECT count(DISTINCT {old}) FROM {t}) AS a, (SELECT count(DISTINCT {new}) FROM r_{t}) AS b,
  (SELECT count(*) FROM (SELECT {old} FROM {t} WHERE {old} IS NOT NULL INTERSECT SELECT {new} FROM r_{t})) AS n"""
    for t, (olds, news) in RENAMED.items()
    for i, (old, f) in enumerate(olds) for j, (new, g) in enumerate(news) if f == g)
SIDES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, '{change}' AS change"
    for t, sides in RENAMED.items() for change, side in zip(("REMOVED", "ADDED"), sides) for c, _ in side)


@query("schema_renames", with_variants("r_orders", "r_customer").replace("WITH", "WITH RECURSIVE", 1) + f""",
pairs AS ({PAIRS_SQL}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n / (a + b - n) DESC, i, j) AS k
  FROM pairs WHERE 2 * n >= a + b - n),
walk AS (
  SELECT DISTINCT t, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM ranked
  UNION ALL
  SELECT r.t, r.k, CASE WHEN list_has_any(w.used, [r.old, r.new]) THEN w.used ELSE w.used || [r.old, r.new] END,
    CASE WHEN NOT list_has_any(w.used, [r.old, r.new]) THEN r.old END,
    CASE WHEN NOT list_has_any(w.used, [r.old, r.new]) THEN r.new END
  FROM walk w JOIN ranked r ON r.t = w.t AND r.k = w.k + 1),
renames AS (SELECT t, old, new FROM walk WHERE old IS NOT NULL),
sides AS ({SIDES_SQL})
SELECT t AS "table", old AS "column", 'RENAMED' AS change, new AS renamed_to FROM renames
UNION ALL SELECT t, c, change, NULL FROM sides s WHERE NOT EXISTS (
  SELECT 1 FROM renames r WHERE r.t = s.t AND (r.old = s.c AND change = 'REMOVED' OR r.new = s.c AND change = 'ADDED'))""")
def schema_renames(spark, root):
    """Changed columns of two tables, a renamed one as one row instead of a removed and an added one."""
    inputs = Inputs(spark, root, *RENAMED, *[f"r_{t}" for t in RENAMED])
    before, after = {t: inputs[t] for t in RENAMED}, {t: inputs[f"r_{t}"] for t in RENAMED}
    names = lambda frames: literal_rows(spark, "table string, column string", [
        (t, c) for t, df in frames.items() for c in df.columns])
    found = inclusion.renamed_columns(before, after)
    renames = literal_rows(spark, "table string, old string, new string", [r[:3] for r in found])
    return drift.with_renames(drift.column_changes(names(before), names(after)), renames)
