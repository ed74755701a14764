"""Compares a query's rows with those of its DuckDB SQL over the same tables."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if value is None or value != value:
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            files = f"{path}/*.parquet" if os.path.isdir(path) and glob.glob(f"{path}/*.parquet") else path
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    cursor = connection(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())


def rows_of(df) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
