"""Profiling queries: columns, duplicates, keys, issues, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from moveproof.operators import findings as fnd
from moveproof.operators import keys as k
from moveproof.operators import profile as p
from moveproof.plans.registry import query
from moveproof.plans.variants import Inputs, variant, with_variants
from moveproof.session import TABLES, literal_rows, stored, tables

# --- layouts of the profiled inputs, for the SQL side -------------------------
LAYOUT = {
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "TEXT"),
               ("o_totalprice", "NUMERIC"), ("o_orderdate", "TIMESTAMP"),
               ("o_orderpriority", "TEXT")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"),
                 ("l_linenumber", "INTEGER"), ("l_quantity", "NUMERIC"),
                 ("l_extendedprice", "NUMERIC"), ("l_discount", "NUMERIC"), ("l_tax", "NUMERIC"),
                 ("l_returnflag", "TEXT"), ("l_linestatus", "TEXT"), ("l_shipdate", "TIMESTAMP")],
    "d_events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"),
                 ("event_type", "TEXT"), ("value", "NUMERIC"), ("props", "TEXT"),
                 ("origin", "TEXT")],
    "documents": [("doc_id", "BIGINT"), ("text", "TEXT"), ("lang", "TEXT"), ("source", "TEXT"),
                  ("n_chars", "BIGINT")],
    "pages": [("page_id", "BIGINT"), ("url", "TEXT"), ("html", "TEXT")],
    "region": [("r_regionkey", "INTEGER"), ("r_name", "TEXT")],
    "nation": [("n_nationkey", "INTEGER"), ("n_name", "TEXT"), ("n_regionkey", "INTEGER")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "TEXT"), ("c_nationkey", "INTEGER"),
                 ("c_acctbal", "NUMERIC"), ("c_mktsegment", "TEXT")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "TEXT"), ("s_nationkey", "INTEGER"),
                 ("s_acctbal", "NUMERIC")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "TEXT"), ("p_brand", "TEXT"),
             ("p_type", "TEXT"), ("p_size", "INTEGER"), ("p_retailprice", "NUMERIC")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"),
               ("event_type", "TEXT"), ("value", "NUMERIC"), ("props", "TEXT")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "TEXT"), ("label", "INTEGER")],
    "benchmark": [("item_id", "BIGINT"), ("text", "TEXT")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INTEGER"), ("toxic", "INTEGER")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "TEXT"),
                      ("text", "TEXT")],
}
LAYOUT["d_lineitem"] = LAYOUT["lineitem"]

SHARE = "CASE WHEN {w} > 0 THEN round(100.0 * {p} / {w}, 2) ELSE 0.0 END"


def share_sql(part: str, whole: str) -> str:
    return SHARE.format(p=part, w=whole)


def counts_sql(dataset: str, source: str | None = None) -> str:
    """Per-column counts of one input, one SELECT per column."""
    out = []
    for i, (c, kind) in enumerate(LAYOUT[dataset]):
        real = kind == "NUMERIC"
        x = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if real else f'"{c}"'
        out.append(
            f"SELECT '{dataset}' AS dataset, '{c}' AS \"column\", {i} AS ordinal, "
            f"'{kind}' AS detected_type, count(*) AS total_rows, "
            f"count(*) - count({x}) AS null_count, count(DISTINCT {x}) AS unique_value_count "
            f"FROM {source or dataset}"
        )
    return " UNION ALL ".join(out)


def columns_sql(*datasets: str) -> str:
    """The full column metrics of several inputs."""
    counts = " UNION ALL ".join(counts_sql(d) for d in datasets)
    return (
        "SELECT 'source' AS database, dataset, \"column\", ordinal, detected_type, total_rows, "
        f"null_count, {share_sql('null_count', 'total_rows')} AS null_percentage, "
        "total_rows - null_count AS non_null_count, unique_value_count, "
        f"{share_sql('unique_value_count', '(total_rows - null_count)')} "
        f"AS uniqueness_percentage FROM ({counts}) c"
    )


def duplicates_sql(*datasets: str) -> str:
    """Rows, width and repeated rows of several inputs."""
    parts = []
    for d in datasets:
        cols = ", ".join(
            f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if t == "NUMERIC" else f'"{c}"'
            for c, t in LAYOUT[d]
        )
        parts.append(
            f"SELECT '{d}' AS dataset, (SELECT count(*) FROM {d}) AS total_rows, "
            f"{len(LAYOUT[d])} AS total_columns, (SELECT count(*) FROM {d}) - "
            f"(SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {d}) u) AS duplicate_rows"
        )
    body = " UNION ALL ".join(parts)
    return (
        "SELECT 'source' AS database, dataset, total_rows, total_columns, duplicate_rows, "
        f"{share_sql('duplicate_rows', 'total_rows')} AS duplicate_percentage FROM ({body}) d"
    )


def frames(spark, root, *names):
    return Inputs(spark, root, *names).only(*names)


@query("profile_basic_customer", duplicates_sql("customer"))
def profile_basic_customer(spark, root):
    return p.duplicate_rows(frames(spark, root, "customer"))


@query("profile_columns_orders", columns_sql("orders"))
def profile_columns_orders(spark, root):
    return p.profile_columns(frames(spark, root, "orders"))


@query("profile_columns_lineitem", columns_sql("lineitem"))
def profile_columns_lineitem(spark, root):
    return p.profile_columns(frames(spark, root, "lineitem"))


@query("profile_columns_events_dirty", with_variants("d_events") + " " + columns_sql("d_events"))
def profile_columns_events_dirty(spark, root):
    return p.profile_columns(frames(spark, root, "d_events"))


@query("profile_columns_approximate", f"""
SELECT "dataset", "column", total_rows, null_count, true AS is_close FROM (
{columns_sql("lineitem", "documents")}) c""")
def profile_columns_approximate(spark, root):
    """The counts that are exact, and whether the distinct counts lie within the sketches' bound."""
    inputs = frames(spark, root, "lineitem", "documents")
    exact = p.profile_columns(inputs).select(
        "dataset", "column", F.col("unique_value_count").alias("wanted"))
    error = F.abs(F.col("unique_value_count") - F.col("wanted"))
    return p.profile_columns(inputs, exact=False).join(exact, ["dataset", "column"]).select(
        "dataset", "column", "total_rows", "null_count", (error <= 0.1 * F.col("wanted") + 1).alias("is_close"))


@query("profile_columns_all", columns_sql(*TABLES))
def profile_columns_all(spark, root):
    return p.profile_columns(tables(spark, root))


@query("profile_duplicates_lineitem",
       with_variants("d_lineitem") + " " + duplicates_sql("lineitem", "d_lineitem"))
def profile_duplicates_lineitem(spark, root):
    return p.duplicate_rows(frames(spark, root, "lineitem", "d_lineitem"))


TEXT_DUPLICATES = """
SELECT 'source' AS database, 'document_text' AS dataset, n AS total_rows, 1 AS total_columns,
       n - u AS duplicate_rows, CASE WHEN n > 0 THEN round(100.0 * (n - u) / n, 2) ELSE 0.0 END
       AS duplicate_percentage
FROM (SELECT count(*) AS n, count(DISTINCT text) AS u FROM documents) t
UNION ALL
SELECT 'source', 'page_html', n, 1, n - u,
       CASE WHEN n > 0 THEN round(100.0 * (n - u) / n, 2) ELSE 0.0 END
FROM (SELECT count(*) AS n, count(DISTINCT html) AS u FROM pages) t
"""


@query("profile_duplicates_text", TEXT_DUPLICATES)
def profile_duplicates_text(spark, root):
    return p.duplicate_rows({
        "document_text": variant(spark, root, "documents").select("text"),
        "page_html": variant(spark, root, "pages").select("html"),
    })


BYTES = {
    "orders": "8 + 8 + strlen(o_orderstatus) + 8 + 8 + strlen(o_orderpriority)",
    "documents": "8 + strlen(text) + strlen(lang) + strlen(source) + 8",
    "embeddings": "8 + 4 * len(embedding) + 4",
    "events": "8 + 8 + 8 + strlen(event_type) + 8 + strlen(props)",
}


WIDE = ("documents", "pages", "conversations", "embeddings", "d_lineitem")


@query("profile_duplicates_wide", with_variants("d_lineitem") + " " + duplicates_sql(*WIDE))
def profile_duplicates_wide(spark, root):
    """Repeated rows by fingerprint; whole rows are compared only where fingerprints repeat."""
    return p.duplicate_rows_by_fingerprint(frames(spark, root, *WIDE))


@query("profile_bytes", " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, CAST(sum({e}) AS BIGINT) AS data_bytes, count(*) AS total_rows "
    f"FROM {t}" for t, e in BYTES.items()))
def profile_bytes(spark, root):
    return p.data_bytes(frames(spark, root, *BYTES))


def quality_sql(*datasets):
    return (
        "SELECT c.database, c.dataset, CAST(sum(c.total_rows) AS BIGINT) AS total_cells, "
        "CAST(sum(c.null_count) AS BIGINT) AS total_null_cells, "
        f"{share_sql('CAST(sum(c.null_count) AS BIGINT)', 'CAST(sum(c.total_rows) AS BIGINT)')} "
        "AS overall_null_percentage, d.duplicate_rows, d.duplicate_percentage, "
        "count(*) FILTER (WHERE c.null_count > 0) AS columns_with_nulls "
        f"FROM ({columns_sql(*datasets)}) c JOIN ({duplicates_sql(*datasets)}) d "
        "ON c.dataset = d.dataset "
        "GROUP BY c.database, c.dataset, d.duplicate_rows, d.duplicate_percentage"
    )


@query("profile_quality_events", with_variants("d_events") + " " + quality_sql("d_events", "events"))
def profile_quality_events(spark, root):
    f = frames(spark, root, "d_events", "events")
    return p.quality_summary(p.profile_columns(f), p.duplicate_rows(f))


# --- keys ---------------------------------------------------------------------
def key_sql(source: str, keys: list[str]) -> str:
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in keys)
    return (
        "SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(z) AS BIGINT) AS null_key_cells, "
        "CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS repeated_key_rows FROM "
        f"(SELECT count(*) AS n, sum({nulls}) AS z FROM {source} GROUP BY {', '.join(keys)}) g"
    )


@query("pk_check_lineitem", key_sql("lineitem", ["l_orderkey", "l_linenumber"]))
def pk_check_lineitem(spark, root):
    return k.key_measures(variant(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pk_check_null", with_variants("d_keys") + " " + key_sql("d_keys", ["o_orderkey"]))
def pk_check_null(spark, root):
    return k.key_measures(variant(spark, root, "d_keys"), ["o_orderkey"])


PK_FINDINGS = with_variants("d_keys") + f""",
m AS ({key_sql("d_keys", ["o_orderkey"])})
SELECT 'd_keys' AS dataset, 'o_orderkey' AS "column", 'PRIMARY_KEY_NULL' AS issue_type,
       'HIGH' AS severity, null_key_cells AS affected_records FROM m WHERE null_key_cells > 0
UNION ALL
SELECT 'd_keys', 'o_orderkey', 'PRIMARY_KEY_DUPLICATE', 'HIGH', repeated_key_rows
FROM m WHERE repeated_key_rows > 0
UNION ALL
SELECT 'orders', 'order_no', 'PRIMARY_KEY_MISSING_COLUMNS', 'HIGH', count(*) FROM orders
"""


@query("pk_findings", PK_FINDINGS)
def pk_findings(spark, root):
    found = k.check_primary_key(variant(spark, root, "d_keys"), "d_keys", ["o_orderkey"])
    absent = k.check_primary_key(
        variant(spark, root, "orders"), "orders", ["o_orderkey", "order_no"]
    )
    return found.unionByName(absent).select(
        "dataset", "column", "issue_type", "severity", "affected_records"
    )


# --- issues -------------------------------------------------------------------
ISSUE_DATASETS = ("d_events", "d_lineitem", "documents", "labels", "region")
SEMANTICS = [
    ("d_events", "event_id", "primary_key"), ("d_events", "value", "required"),
    ("d_events", "props", "optional"), ("d_events", "ts", "required"),
    ("documents", "text", "required"),
]
ISSUE_COLUMNS = ("database", "dataset", "column", "source", "issue_type", "severity",
                 "affected_records", "affected_percentage", "message", "position")


def semantics(spark):
    return literal_rows(spark, "dataset string, column string, semantic string", SEMANTICS)


def profile_findings(inputs, duplicates=None):
    """Findings of the damaged inputs, with key checks where a key is declared."""
    spark, f = inputs.spark, inputs.only(*ISSUE_DATASETS)
    repeats = p.duplicate_rows(f) if duplicates is None else duplicates
    key_issues = k.check_primary_key(f["d_events"], "d_events", ["event_id"]).drop(
        "run_id", "source", "expected", "actual"
    )
    return p.profiling_issues(
        p.profile_columns(f), repeats, semantics(spark), key_issues
    )


SEMANTICS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}')" for a, b, c in SEMANTICS
) + ') v(dataset, "column", semantic)'

ISSUES_CTES = with_variants("d_events", "d_lineitem") + f""",
cols AS ({columns_sql(*ISSUE_DATASETS)}),
dups AS ({duplicates_sql(*ISSUE_DATASETS)}),
sem AS ({SEMANTICS_SQL}),
ruled AS (SELECT c.*, s.semantic FROM cols c LEFT JOIN sem s
          ON c.dataset = s.dataset AND c."column" = s."column"),
profile_issues AS (
SELECT database, dataset, '' AS "column", 'DUPLICATE_ROWS' AS issue_type,
       CASE WHEN duplicate_percentage >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       duplicate_rows AS affected_records, duplicate_percentage AS affected_percentage,
       concat(duplicate_rows, ' of ', total_rows, ' rows repeat an earlier row') AS message,
       -1 AS position
FROM dups WHERE duplicate_rows > 0
UNION ALL
SELECT database, dataset, "column",
       CASE WHEN semantic = 'optional' THEN 'NULL_VALUES_OPTIONAL' ELSE 'NULL_VALUES' END,
       CASE WHEN semantic = 'optional' THEN 'LOW' WHEN null_percentage >= 80 THEN 'HIGH'
            WHEN null_percentage >= 30 THEN 'MEDIUM' ELSE 'LOW' END,
       null_count, null_percentage,
       concat(null_count, ' of ', total_rows, ' values of ', "column", ' are null'), ordinal
FROM ruled WHERE null_count > 0 AND (semantic IN ('required', 'primary_key')
      OR (semantic = 'optional' AND null_percentage < 95))
UNION ALL
SELECT database, dataset, "column", 'CONSTANT_COLUMN', 'LOW', non_null_count, NULL,
       concat('every filled value of ', "column", ' is the same'), ordinal
FROM cols WHERE non_null_count > 0 AND unique_value_count = 1
)
"""


@query("profile_issues", ISSUES_CTES + """
SELECT database, dataset, "column", 'PROFILING' AS source, issue_type, severity, affected_records,
       affected_percentage, message, position FROM profile_issues""")
def profile_issues(spark, root):
    return profile_findings(Inputs(spark, root, *ISSUE_DATASETS)).select(*ISSUE_COLUMNS)


@query("issue_summary", ISSUES_CTES + """
SELECT database, dataset, count(*) AS total_issues,
       count(*) FILTER (WHERE severity = 'HIGH') AS high_severity_issues,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_severity_issues,
       count(*) FILTER (WHERE severity = 'LOW') AS low_severity_issues
FROM profile_issues GROUP BY database, dataset""")
def issue_summary(spark, root):
    return fnd.issue_counts(profile_findings(Inputs(spark, root, *ISSUE_DATASETS)), ["database", "dataset"])


ROLLUP = ISSUES_CTES + f""",
q AS ({quality_sql(*ISSUE_DATASETS)}),
i AS (SELECT dataset, count(*) AS issues,
             count(*) FILTER (WHERE severity = 'HIGH') AS high_issues,
             count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_issues,
             count(*) FILTER (WHERE severity = 'LOW') AS low_issues
      FROM profile_issues GROUP BY dataset),
b AS (SELECT 'd_events' AS dataset, sum(8 + 8 + 8 + strlen(event_type)
             + CASE WHEN value IS NULL THEN 0 ELSE 8 END + coalesce(strlen(props), 0) + 3) AS bytes
      FROM d_events
      UNION ALL SELECT 'd_lineitem', sum(8 * 3 + 4 + 8 * 4 + strlen(l_returnflag)
             + strlen(l_linestatus) + 8) FROM d_lineitem
      UNION ALL SELECT 'documents', sum(8 + strlen(text) + strlen(lang) + strlen(source) + 8)
             FROM documents
      UNION ALL SELECT 'labels', sum(16) FROM labels
      UNION ALL SELECT 'region', sum(4 + strlen(r_name)) FROM region)
SELECT d.database, d.dataset, count(*) AS datasets,
       CAST(sum(d.total_rows) AS BIGINT) AS total_rows,
       CAST(sum(d.total_columns) AS BIGINT) AS total_columns,
       CAST(sum(b.bytes) AS BIGINT) AS data_bytes,
       CAST(sum(q.total_null_cells) AS BIGINT) AS total_null_cells,
       CAST(sum(d.duplicate_rows) AS BIGINT) AS duplicate_rows,
       CAST(sum(coalesce(i.issues, 0)) AS BIGINT) AS issues,
       CAST(sum(coalesce(i.high_issues, 0)) AS BIGINT) AS high_issues,
       CAST(sum(coalesce(i.medium_issues, 0)) AS BIGINT) AS medium_issues,
       CAST(sum(coalesce(i.low_issues, 0)) AS BIGINT) AS low_issues
FROM dups d JOIN q ON q.dataset = d.dataset LEFT JOIN i ON i.dataset = d.dataset
     LEFT JOIN b ON b.dataset = d.dataset
GROUP BY GROUPING SETS ((d.database, d.dataset), (d.database))
"""


@query("profile_rollup", ROLLUP)
def profile_rollup(spark, root):
    f = frames(spark, root, *ISSUE_DATASETS)
    columns = stored(p.profile_columns(f), "columns")
    duplicates = stored(p.duplicate_rows(f), "duplicates")
    issues = p.profiling_issues(columns, duplicates, semantics(spark))
    summary = p.quality_summary(columns, duplicates).join(
        duplicates.select("database", "dataset", "total_rows", "total_columns"),
        ["database", "dataset"],
    )
    return p.database_totals(summary, issues, p.data_bytes(f).drop("total_rows"))


COLS = [c for c, _ in LAYOUT["lineitem"]]


@query("dedup_lineitem", with_variants("d_lineitem") + f"""
SELECT {", ".join(COLS)}, count(*) AS copies FROM d_lineitem GROUP BY {", ".join(COLS)}""")
def dedup_lineitem(spark, root):
    df = variant(spark, root, "d_lineitem")
    return df.groupBy(*COLS).agg(F.count(F.lit(1)).alias("copies"))


@query("dedup_text_first", """
SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source,
       arg_min(n_chars, doc_id) AS n_chars, count(*) AS copies FROM documents GROUP BY text""")
def dedup_text_first(spark, root):
    return p.keep_first(variant(spark, root, "documents"), ["text"], ["doc_id"])


@query("custom_checks", """
SELECT 'orders' AS dataset, issue_type, severity, affected_records,
       round(100.0 * affected_records / n, 2) AS affected_percentage
FROM (SELECT 'LOW_PRICE' AS issue_type, 'MEDIUM' AS severity,
             count(*) FILTER (WHERE NOT o_totalprice >= 5000) AS affected_records, count(*) AS n
      FROM orders
      UNION ALL SELECT 'UNKNOWN_STATUS', 'HIGH',
             count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FROM orders) x
WHERE affected_records > 0""")
def custom_checks(spark, root):
    checks = [
        ("LOW_PRICE", "MEDIUM", "price below 5000", F.col("o_totalprice") >= 5000),
        ("UNKNOWN_STATUS", "HIGH", "status is neither F nor O",
         F.col("o_orderstatus").isin("F", "O")),
    ]
    return fnd.run_checks(variant(spark, root, "orders"), "orders", checks).select(
        "dataset", "issue_type", "severity", "affected_records", "affected_percentage"
    )
