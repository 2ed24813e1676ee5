"""Spark results against DuckDB's, row by row in any order."""

from __future__ import annotations

import os

import duckdb


def normal(rows, columns):
    def one(v):
        if v is None or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([one(r[i]) for i in at] for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(spark_df, sql: str, sf_dir: str) -> None:
    found = duck(sf_dir).sql(sql)
    assert sorted(spark_df.columns) == sorted(found.columns)
    ours, theirs = normal([tuple(r) for r in spark_df.collect()], spark_df.columns), normal(found.fetchall(), found.columns)
    assert ours == theirs
