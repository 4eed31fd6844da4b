"""Compare a query with its SQL: rows as multisets over columns in name order."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

from lakejobs.plans.registry import TABLES


def oracle_connection(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, sf_dir, query, sql, connection):
    """None if both give the same rows, else a short description."""
    df = query(spark, sf_dir)
    joins = df._jdf.queryExecution().executedPlan().toString()
    if "NestedLoopJoin" in joins or "CartesianProduct" in joins:
        return "the plan joins every row with every row"
    names, ours = rows_of(df.columns, df.collect())
    cursor = connection.execute(sql)
    expected_names, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected_names:
        return f"columns {names} vs {expected_names}"
    if ours != expected:
        missing, extra = list((expected - ours).items())[:2], list((ours - expected).items())[:2]
        return f"{ours.total()} vs {expected.total()} rows; missing {missing}; extra {extra}"
    return None
