"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from moveproof.session import TABLES


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


# --- type names both engines must agree on ---
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def spark_side(df):
    return df.columns, [tuple(r) for r in df.collect()], [
        KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields
    ]


def duck_side(con, sql):
    rel = con.sql(sql)
    return rel.columns, rel.fetchall(), [str(t) for t in rel.types]


def difference(spark, con, plan, sql, root) -> str | None:
    """None when both agree in names, types and rows."""
    columns, rows, types = spark_side(plan(spark, root))
    columns2, rows2, types2 = duck_side(con, sql)
    if sorted(columns) != sorted(columns2):
        return f"columns {sorted(set(columns) ^ set(columns2))}"
    t1, t2 = dict(zip(columns, types)), dict(zip(columns2, types2))
    off = {c: (t1[c], t2[c]) for c in columns if t1[c] != t2[c]}
    if off:
        return f"types {off}"
    _, a = normalized(columns, rows)
    names, b = normalized(columns2, rows2)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}: {a[:3]} vs {b[:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ {names}: {bad[:2]}" if bad else None
