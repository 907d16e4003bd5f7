"""Comparison of a query with its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def _cell(v):
    if v is None or type(v).__name__ == "NAType" or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(_cell, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


def sql_rows(sql, data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    con.execute(sql)
    names = [c[0] for c in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in con.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[c]) for c in names) for r in df.select(*names).collect())
