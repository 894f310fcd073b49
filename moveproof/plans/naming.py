"""Name and type queries over names held as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof import rules
from moveproof.functions import names as nm
from moveproof.functions import types as ty
from moveproof.operators import shape
from moveproof.plans.registry import query
from moveproof.plans.variants import variant, with_variants
from moveproof.session import literal_rows, table

WORDS = (
    r"regexp_replace(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), "
    r"'([a-z0-9])([A-Z])', '\1_\2', 'g'), '[-\s.]+', '_', 'g')"
)


def words(expr: str) -> str:
    return WORDS.format(expr)


def cased(expr: str, first: str) -> str:
    cap = "concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))"
    body = f"CASE WHEN i = 1 THEN {first} ELSE {cap} END"
    return (f"array_to_string(list_transform(string_split({words(expr)}, '_'), "
            f"lambda x, i: {body}), '')")


CAP = "concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))"


@query("naming_styles", with_variants("names") + f"""
SELECT "table", ordinal, name, lower({words('name')}) AS snake_case,
       replace(lower({words('name')}), '_', '-') AS kebab_case,
       {cased('name', 'lower(x)')} AS camel_case, {cased('name', CAP)} AS pascal_case,
       lower(name) AS lowercase, upper(name) AS uppercase, name AS preserve FROM names""")
def naming_styles(spark, root):
    labels = {"snake_case": "snake_case", "kebab-case": "kebab_case", "camelCase": "camel_case",
              "PascalCase": "pascal_case", "lowercase": "lowercase", "UPPERCASE": "uppercase",
              "preserve": "preserve"}
    return variant(spark, root, "names").select(
        "table", "ordinal", "name",
        *[nm.styled(F.col("name"), s).alias(a) for s, a in labels.items()],
    )


def replaced_sql(expr: str) -> str:
    for old, new in rules.CHARACTER_REPLACEMENTS:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


def tidied_sql(expr: str) -> str:
    inner = f"regexp_replace(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'), '_+', '_', 'g')"
    return f"nullif(regexp_replace({inner}, '^_+|_+$', '', 'g'), '')"


# what the query's user overrides, for names that the style would spell otherwise
OVERRIDES = {"CustomerID": "client_number", "ContactEmail": "mail"}
OVERRIDE_SQL = "CASE lower(name) " + " ".join(
    f"WHEN '{k.lower()}' THEN '{v}'" for k, v in OVERRIDES.items()
) + " END"
TARGET_SQL = f"coalesce({OVERRIDE_SQL}, {tidied_sql(f'lower({words(replaced_sql('name'))})')})"
RESOLVED = with_variants("names") + f""",
resolved AS (SELECT "table", ordinal, name, {TARGET_SQL} AS target FROM names)"""


def resolved(spark, root):
    return variant(spark, root, "names").withColumn("target", nm.resolved(
        F.col("name"), "snake_case", rules.CHARACTER_REPLACEMENTS, OVERRIDES
    ))


@query("resolve_names", RESOLVED + " SELECT * FROM resolved")
def resolve_names(spark, root):
    return resolved(spark, root)


# names that are numbered already arrive before and after the names they could collide with
CHAINED = RESOLVED + """,
chained AS (
SELECT "table", ordinal * 2 AS ordinal, target FROM resolved WHERE target IS NOT NULL
UNION ALL SELECT "table", ordinal * 2 + 1, concat(target, CASE WHEN ordinal % 2 = 0 THEN '_2' ELSE '_3' END)
FROM resolved WHERE ordinal % 3 = 0 AND target IS NOT NULL)"""


def chained(spark, root):
    names = resolved(spark, root).select("table", "ordinal", "target").dropna(subset=["target"])
    ending = F.when(F.col("ordinal") % 2 == 0, "_2").otherwise("_3")
    return names.withColumn("ordinal", F.col("ordinal") * 2).unionByName(
        names.filter(F.col("ordinal") % 3 == 0).select(
            "table", (F.col("ordinal") * 2 + 1).alias("ordinal"), F.concat("target", ending).alias("target")))


@query("resolve_collisions", CHAINED + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY "table", target ORDER BY ordinal) AS arrival
             FROM chained),
taken AS (SELECT "table", target, n - row_number() OVER (PARTITION BY "table", target ORDER BY n) + 1 AS at
  FROM (SELECT DISTINCT "table", regexp_extract(target, '^(.*)_([1-9][0-9]{0,17})$', 1) AS target,
               TRY_CAST(regexp_extract(target, '^(.*)_([1-9][0-9]{0,17})$', 2) AS BIGINT) AS n
        FROM chained) c WHERE n > 1),
placed AS (SELECT *, CASE WHEN arrival = 1 THEN 0 ELSE (SELECT count(*) FROM taken t
    WHERE t."table" = f."table" AND t.target = f.target AND t.at <= f.arrival) END AS moved
  FROM numbered f)
SELECT "table", ordinal, target, arrival,
  CASE WHEN arrival = 1 THEN target ELSE concat(target, '_', arrival + moved) END AS final_name,
  moved > 0 AS is_moved FROM placed""")
def resolve_collisions(spark, root):
    return shape.resolve_collisions(chained(spark, root), chunk_width=500)


@query("empty_names", with_variants("names") + """
SELECT "table", ordinal, ' *__* ' AS name, 'EMPTY_NAME' AS issue_type, 'HIGH' AS severity
FROM names WHERE ordinal % 17 = 0""")
def empty_names(spark, root):
    """Some names hold nothing but characters that clean-up takes away."""
    blank = F.when(F.col("ordinal") % 17 == 0, " *__* ").otherwise(F.col("name"))
    names = variant(spark, root, "names").withColumn("name", blank).withColumn("target", nm.resolved(
        F.col("name"), "snake_case", rules.CHARACTER_REPLACEMENTS, OVERRIDES))
    return shape.empty_names(names, "target").select("table", "ordinal", "name", "issue_type", "severity")


NORMAL = "regexp_replace(regexp_replace(lower({0}), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("mapping_collisions", with_variants("names") + f"""
SELECT "table", target, count(DISTINCT name) AS sources FROM (
  SELECT "table", name, {NORMAL.format("regexp_replace(name, '^[0-9 ]+|[0-9 ]+$', '', 'g')")}
    AS target FROM names) n
GROUP BY "table", target HAVING count(DISTINCT name) > 1""")
def mapping_collisions(spark, root):
    bare = F.regexp_replace("name", "^[0-9 ]+|[0-9 ]+$", "")
    names = variant(spark, root, "names").select(
        "table", "name", nm.column_target(bare).alias("target")
    )
    return shape.target_collisions(names)


@query("map_columns_supplier", """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey AS s_countrykey
FROM supplier""")
def map_columns_supplier(spark, root):
    supplier = table(spark, root, "supplier")
    names = shape.mapped_names(
        supplier, manual={"s_suppkey": "supplier_id", "S_NAME": "supplier_name"},
        dictionary={"Nation": "Country"}, ignore=["S_ACCTBAL"],
    )
    return shape.map_columns(supplier, names)


TABLE_MAP = {"Customer Records": "customers", "brand#1 economy": "first_economy",
             "Brand#2": "second_brand", "standard": "standard_goods"}


@query("map_tables", f"""
SELECT source_name, CASE WHEN source_name = 'Customer Records' THEN 'customers'
  WHEN norm = 'brand#1 economy' THEN 'first_economy'
  WHEN contains(norm, 'customer records') THEN 'customers'
  WHEN contains(norm, 'brand#1 economy') THEN 'first_economy'
  WHEN contains(norm, 'brand#2') THEN 'second_brand'
  WHEN contains(norm, 'standard') THEN 'standard_goods' ELSE norm END AS target_name
FROM (SELECT source_name, {NORMAL.format('trim(source_name)')} AS norm FROM (
  SELECT CASE WHEN p_partkey % 10 = 0 THEN 'Customer Records'
              WHEN p_partkey % 10 = 1 THEN concat(' Customer Records ', p_size)
              ELSE concat(p_brand, ' ', p_type, '__') END AS source_name FROM part) s) n""")
def map_tables(spark, root):
    key = F.col("p_partkey") % 10
    source = (
        F.when(key == 0, "Customer Records")
        .when(key == 1, F.format_string(" Customer Records %d", "p_size"))
        .otherwise(F.concat("p_brand", F.lit(" "), "p_type", F.lit("__")))
    )
    return table(spark, root, "part").select(source.alias("source_name")).withColumn(
        "target_name", nm.table_target(F.col("source_name"), TABLE_MAP)
    )


# --- types --------------------------------------------------------------------------
TEXT_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority", "o_orderday")


def detect_sql(source: str) -> str:
    parts = []
    for i, c in enumerate(TEXT_COLUMNS):
        v = f"trim({c})"
        stamp = "[0-9]{1,2}-[0-9]{1,2}"
        parts.append(f"""
SELECT '{source}' AS dataset, '{c}' AS "column", {i} AS ordinal,
       count(nullif({v}, '')) AS filled_values,
       CASE WHEN count(nullif({v}, '')) = 0 THEN 'TEXT'
            WHEN bool_and(regexp_full_match({v}, '-?[0-9]+')) FILTER (WHERE {v} <> '') THEN 'INTEGER'
            WHEN bool_and(regexp_full_match({v}, '-?[0-9]+(\\.[0-9]+)?')) FILTER (WHERE {v} <> '')
              THEN 'NUMERIC'
            WHEN bool_and(regexp_full_match({v}, '[0-9]{{4}}-{stamp}')
                 AND try_strptime({v}, '%Y-%m-%d') IS NOT NULL) FILTER (WHERE {v} <> '') THEN 'DATE'
            WHEN bool_and(regexp_matches({v}, '^[0-9]{{4}}-{stamp} ')
                 AND try_strptime({v}, '%Y-%m-%d %H:%M:%S') IS NOT NULL)
                 FILTER (WHERE {v} <> '') THEN 'TIMESTAMP'
            ELSE 'TEXT' END AS detected_type FROM {source}""")
    return " UNION ALL ".join(parts)


@query("detect_types_orders", with_variants("s_orders") + detect_sql("s_orders"))
def detect_types_orders(spark, root):
    return ty.detect_types(variant(spark, root, "s_orders"), "s_orders")


@query("detect_types_dirty", with_variants("s_orders_dirty") + detect_sql("s_orders_dirty"))
def detect_types_dirty(spark, root):
    return ty.detect_types(variant(spark, root, "s_orders_dirty"), "s_orders_dirty")


PREVIOUS_TYPES = [("s_orders_dirty", "o_orderkey", "BIGINT"), ("s_orders_dirty", "o_custkey", " null"),
                  ("s_orders_dirty", "o_orderpriority", " VARCHAR "),
                  ("s_orders_dirty", "o_totalprice", "")]


@query("datatype_registry", with_variants("s_orders_dirty") + f""",
found AS ({detect_sql("s_orders_dirty")}),
first AS (SELECT * FROM s_orders_dirty ORDER BY o_orderkey LIMIT 1),
samples AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS c, {c} AS sample_value FROM first" for c in TEXT_COLUMNS)})
SELECT 's_orders_dirty' AS "table", f."column", f.detected_type,
       CASE f."column" WHEN 'o_orderkey' THEN 'BIGINT' WHEN 'o_orderpriority' THEN 'VARCHAR'
            ELSE f.detected_type END AS selected_type, s.sample_value
FROM found f JOIN samples s ON s.c = f."column" """)
def datatype_registry(spark, root):
    previous = literal_rows(
        spark, "table string, column string, selected_type string", PREVIOUS_TYPES
    )
    return ty.datatype_registry(
        variant(spark, root, "s_orders_dirty"), "s_orders_dirty", "o_orderkey", previous
    )


def physical_sql(target: str) -> str:
    return "CASE upper(logical_type) " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in rules.PHYSICAL_TYPES[target].items()
    ) + " END"


USABLE = "CASE WHEN trim({0}) <> '' AND lower(trim({0})) <> 'null' THEN trim({0}) END"


@query("resolve_types", with_variants("type_registry") + f"""
SELECT "table", "column", logical_type, {physical_sql("MYSQL")} AS mysql_type,
       {physical_sql("POSTGRESQL")} AS postgresql_type, {physical_sql("MSSQL")} AS mssql_type,
       {physical_sql("MYSQL")} IS NULL AS is_unsupported
FROM (SELECT *, coalesce({USABLE.format('selected_type')}, {USABLE.format('detected_type')}, 'TEXT')
      AS logical_type FROM type_registry) t""")
def resolve_types(spark, root):
    logical = ty.resolved_type(F.col("selected_type"), F.col("detected_type"))
    targets = ("MYSQL", "POSTGRESQL", "MSSQL")
    return variant(spark, root, "type_registry").withColumn("logical_type", logical).select(
        "table", "column", "logical_type",
        *[ty.physical_type(F.col("logical_type"), t).alias(f"{t.lower()}_type") for t in targets],
        ty.physical_type(F.col("logical_type"), "MYSQL").isNull().alias("is_unsupported"),
    )


HINT_NAMES = ("CASE p_size % 12 WHEN 0 THEN 'ID' WHEN 1 THEN 'CustomerID' WHEN 2 THEN 'Email' "
              "WHEN 3 THEN 'JoinDate' WHEN 4 THEN 'price' WHEN 5 THEN 'PHONE' WHEN 6 THEN 'Total' "
              "ELSE p_name END")


@query("name_hint_types", f"""
SELECT p_partkey, name, CASE
  WHEN lower(name) IN ('id', 'customerid', 'userid', 'orderid', 'productid', 'sellerid') THEN 'INT'
  WHEN lower(name) IN ('joindate', 'createddate', 'modifieddate') THEN 'DATETIME'
  WHEN lower(name) IN ('salary', 'price', 'amount', 'total') THEN 'DECIMAL(10,2)'
  WHEN lower(name) = 'phone' THEN 'VARCHAR(20)' ELSE 'VARCHAR(255)' END AS hinted_type,
  lower(name) IN ('id', 'customerid', 'userid', 'orderid', 'productid', 'sellerid') AS is_key
FROM (SELECT p_partkey, {HINT_NAMES} AS name FROM part) n""")
def name_hint_types(spark, root):
    names = table(spark, root, "part").select("p_partkey", F.expr(HINT_NAMES).alias("name"))
    return names.select(
        "p_partkey", "name", ty.hinted_type(F.col("name")).alias("hinted_type"),
        ty.hinted_key(F.col("name")).alias("is_key"),
    )
