"""Derived inputs of the registered queries, as frames and as the same SQL.

Each variant brings one kind of damage into the given tables: lost rows,
dropped columns, nulls, repeats, orphans, earlier states, text forms.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from moveproof.session import TABLES, table, tables

SQL = {
    "t_orders": "SELECT * FROM orders WHERE o_orderkey % 50 <> 0",
    "t_lineitem": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
                  "l_extendedprice, l_returnflag, l_shipdate FROM lineitem",
    "t_customer": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer",
    "d_events": "SELECT event_id, ts, user_id, event_type, "
                "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 13 = 0 "
                "THEN CAST('NaN' AS DOUBLE) ELSE value END AS value, "
                "CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS props, "
                "'web' AS origin FROM events",
    "d_lineitem": "SELECT * FROM lineitem UNION ALL "
                  "SELECT * FROM lineitem WHERE l_orderkey % 10 = 0",
    "d_keys": "SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey END AS o_orderkey, "
              "o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL "
              "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders "
              "WHERE o_orderkey % 53 = 0",
    "d_orders_fk": "SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN o_custkey + 1000000 "
                   "WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders",
    "d_customer_nullkey": "SELECT c_custkey FROM customer UNION ALL SELECT CAST(NULL AS BIGINT)",
    "p_customer": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 "
                  "THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment "
                  "FROM customer WHERE c_custkey % 7 <> 0 UNION ALL "
                  "SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment "
                  "FROM customer WHERE c_custkey % 11 = 0",
    "r_orders": "SELECT o_orderkey, o_custkey AS customer_ref, o_totalprice AS amount, o_orderdate, "
                "o_orderpriority AS prio, concat(o_orderstatus, 'x') AS state FROM orders WHERE o_orderkey % 10 <> 0",
    "r_customer": "SELECT c_custkey AS id, c_name AS full_name, c_nationkey, c_acctbal AS balance, c_mktsegment, "
                  "c_name AS same_name FROM customer WHERE c_custkey % 7 <> 0",
    "s_orders": "SELECT CAST(o_orderkey AS STRING) AS o_orderkey, "
                "CAST(o_custkey AS STRING) AS o_custkey, o_orderstatus, "
                "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS o_totalprice, "
                "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS o_orderdate, "
                "o_orderpriority, date_format(o_orderdate, 'yyyy-MM-dd') AS o_orderday FROM orders",
    "s_orders_dirty": "SELECT o_orderkey, CASE WHEN CAST(o_orderkey AS BIGINT) % 6 = 0 THEN '  ' "
                      "ELSE o_custkey END AS o_custkey, o_orderstatus, "
                      "CASE WHEN CAST(o_orderkey AS BIGINT) % 97 = 0 THEN 'N/A' "
                      "ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority, "
                      "CASE WHEN CAST(o_orderkey AS BIGINT) = 101 THEN '2023-02-30' "
                      "ELSE o_orderday END AS o_orderday FROM s_orders",
    # one "database" per customer that has orders; measures follow from the order keys
    "fleet": "SELECT '' AS run_id, concat('db_', CAST(o_custkey AS STRING)) AS database, "
             "s % 3 AS profiling_high, s % 5 AS profiling_medium, s % 7 AS profiling_low, "
             "s % 2 AS reconciliation_high, s % 4 AS reconciliation_medium, "
             "s % 6 AS reconciliation_low, "
             "CASE WHEN s % 17 = 0 THEN 'NOT_EXECUTED_DATABASE_REQUIRED' ELSE 'EXECUTED' END "
             "AS reconciliation_status, (s + n) % 5 AS missing_target_datasets, "
             "(s + n) % 8 AS extra_target_datasets, (s + n) % 7 AS not_reconciled_datasets, "
             "CASE WHEN s % 13 = 0 THEN 'BASELINE_CREATED' ELSE 'ANALYZED' END AS growth_status, "
             "CASE WHEN s % 13 = 0 OR s % 11 = 0 THEN NULL ELSE CAST(s % 83 - 20 AS DOUBLE) END "
             "AS overall_growth_rate_percent, "
             "CAST(CASE s % 4 WHEN 0 THEN 0 WHEN 1 THEN 365 WHEN 2 THEN 1095 ELSE 2555 END AS INT) "
             "AS retention_days, n % 2 = 0 AS archive_required, "
             "CAST(CASE s % 5 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 120 "
             "ELSE 240 END AS INT) AS max_duration_minutes, "
             "CAST(CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 15 ELSE 60 END AS INT) "
             "AS max_downtime_minutes, s * 137 % 15000000 AS total_rows, "
             "n * 11 % 130 AS total_datasets, s % 1200 AS total_columns FROM ("
             "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, "
             "CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey) x",
    # runs and their stages
    "run_events": "SELECT CAST(user_id % 20 AS BIGINT) AS run_id, event_type AS stage, ts, "
                  "event_id AS event_no, CASE WHEN event_type = 'error' AND user_id % 3 = 0 "
                  "THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events",
    # names as data: one "table" per brand, one column name per part
    "names": "SELECT p_brand AS \"table\", p_partkey AS ordinal, CASE p_partkey % 6 "
             "WHEN 0 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), 'ID') "
             "WHEN 1 THEN concat(' ', p_name, '__', p_type) "
             "WHEN 2 THEN concat(p_brand, '-', p_type, '.', p_name) "
             "WHEN 3 THEN concat(lower(p_type), upper(substr(p_name, 1, 1)), substr(p_name, 2), "
             "'HTTPKey') WHEN 4 THEN concat(p_type, '*', p_name, '@x') "
             "ELSE CASE WHEN p_size % 2 = 0 THEN 'CustomerID' ELSE 'contactemail' END END AS name "
             "FROM part",
    # a type registry as data: one row per part
    "type_registry": "SELECT p_brand AS \"table\", concat('c', CAST(p_partkey AS STRING)) "
                     "AS \"column\", CASE p_partkey % 7 WHEN 0 THEN 'BIGINT' WHEN 1 THEN ' null ' "
                     "WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'varchar ' WHEN 5 THEN 'JSONB' "
                     "ELSE 'DATE' END AS selected_type, CASE p_size % 5 WHEN 0 THEN 'INTEGER' "
                     "WHEN 1 THEN 'NUMERIC' WHEN 2 THEN 'TIMESTAMP' WHEN 3 THEN NULL "
                     "ELSE 'TEXT' END AS detected_type FROM part",
    # column registries of one "table" per customer: the priorities and states of its orders
    "registry_prev": "SELECT concat('t', CAST(o_custkey AS STRING)) AS \"table\", "
                     "min(o_orderkey) AS ordinal, CASE WHEN o_custkey % 3 = 0 THEN "
                     "upper(o_orderpriority) ELSE lower(o_orderpriority) END AS \"column\" "
                     "FROM orders "
                     "WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' "
                     "GROUP BY o_custkey, o_orderpriority",
    "registry_cur": "SELECT concat('t', CAST(o_custkey AS STRING)) AS \"table\", "
                    "min(o_orderkey) AS ordinal, lower(o_orderpriority) AS \"column\" FROM orders "
                    "WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' "
                    "GROUP BY o_custkey, o_orderpriority",
}

NEEDS = {
    "s_orders_dirty": ["s_orders"],
}


def duck(text: str) -> str:
    """The few places where the two SQL dialects spell a variant differently."""
    return (
        text.replace("AS STRING", "AS VARCHAR")
        .replace("date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')",
                 "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")
        .replace("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')")
    )


def with_variants(*names: str) -> str:
    """WITH clause (no trailing comma) defining the named variants for SQL."""
    ordered: list[str] = []
    for n in names:
        for need in [*NEEDS.get(n, []), n]:
            if need not in ordered:
                ordered.append(need)
    return "WITH " + ", ".join(f"{n} AS ({duck(SQL[n])})" for n in ordered)


def _sources(name: str) -> list[str]:
    return [s for s in [*TABLES, *SQL] if s != name and re.search(rf"FROM {s}\b", SQL[name])]


def _base_tables(name: str) -> set[str]:
    return {name} if name in TABLES else set().union(*map(_base_tables, _sources(name)))


class Inputs(dict):
    """Given tables and variants by name, each read once per query.

    Base tables are bound to the variant's SQL as frames, not as catalog views.
    """

    def __init__(self, spark: SparkSession, root: str, *names: str):
        super().__init__()
        self.spark, self.root = spark, root
        self.update(tables(spark, root, sorted(set().union(*map(_base_tables, names)))))
        for name in names:
            self[name]

    def __missing__(self, name: str) -> DataFrame:
        if name in TABLES:
            self[name] = table(self.spark, self.root, name)
            return self[name]
        text = SQL[name].replace('"', "`")
        bound = {}
        for source in _sources(name):
            text = re.sub(rf"FROM {source}\b", f"FROM {{{source}}}", text)
            bound[source] = self[source]
        self[name] = self.spark.sql(text, **bound)
        return self[name]

    def only(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}


def variant(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Inputs(spark, root, name)[name]


def counts_sql(source: str, name: str, columns: int) -> str:
    return (f"SELECT '{name}' AS dataset, count(*) AS record_count, "
            f"{columns} AS column_count FROM {source}")


