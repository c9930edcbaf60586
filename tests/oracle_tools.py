"""Run a query's SQL in DuckDB and compare it with the Spark result, whatever the row order."""

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        table, path = name.split(".")[0], f"{folder}/{name}"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs
