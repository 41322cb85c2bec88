"""Rows of a query and of its SQL in DuckDB, in one form."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return round(value, 6) if isinstance(value, float) else value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=str)


def rows_of_sql(con, sql):
    columns = sorted(con.sql(sql).columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted((tuple(map(_plain, r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=str)


def assert_same(df, con, sql):
    got, want = rows_of(df), rows_of_sql(con, sql)
    assert got[0] == want[0]
    assert got[1] == want[1]
