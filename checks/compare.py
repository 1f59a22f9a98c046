"""Run registered queries against their SQL: ``python -m checks.compare DIR [NAME ...]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from ledgerlens.session import build_session


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def difference(spark, connection, name: str, sf_dir: str) -> str | None:
    """None when Spark and SQL agree to the last digit, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in ORACLE:
        return None
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    left, right = rows_of(df.columns, got), rows_of(columns, expected)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} against {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            found = difference(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        kind = "ok" if name in ORACLE else "rows only"
        print(f"{name:32} {time.time() - started:6.2f}s  {found or kind}", flush=True)
    print(f"{failed} of {len(names or QUERIES)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
