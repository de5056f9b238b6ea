"""Run registered queries on Spark and their SQL on DuckDB and compare the whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def check(spark, folder, connection, item, tables):
    start = time.time()
    frame = item.plan(tables)
    got = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    if not item.sql:
        return f"rows-only {len(got)}", spent, len(got)
    cursor = connection.execute(item.sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} != {sorted(names)}", spent, len(got)
    a, b = rows_of(frame.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"DIFF rows {len(a)}/{len(b)}\n   spark  {only_a}\n   oracle {only_b}", spent, len(got)
    kinds = {type(v) for r in got[:200] for v in r} & {decimal.Decimal, list, dict}
    return ("ok" + (f" (types {kinds})" if kinds else "")), spent, len(got)


def main(folder: str, prefixes: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__  # noqa: F401
    from granary.plans.registry import REGISTRY, Tables
    from granary.session import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark__sql__shuffle__partitions": "8",
            "spark__ui__enabled": "false",
            "spark__driver__memory": "8g",
            "spark__ui__showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(folder)
    bad = 0
    for name, item in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            verdict, spent, count = check(spark, folder, connection, item, Tables(spark, folder))
        except Exception as error:  # report and go on
            verdict, spent, count = f"ERROR {type(error).__name__}: {str(error)[:700]}", 0.0, 0
        bad += not (verdict.startswith("ok") or verdict.startswith("rows-only"))
        print(f"{name:36s} {spent:6.2f}s {count:6d} {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
