"""Results of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        out.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return out


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return None if x != x else round(float(x), 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, int):
        return round(float(x), 5)
    return x


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts that both give the same rows under the same names; returns how many."""
    got = canonical(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(spark_df.columns)
    assert got == canonical(names, result.fetchall())
    return len(got)
