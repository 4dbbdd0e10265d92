"""Compares Spark results with DuckDB results, row by row."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v: object) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, pd.Timestamp | dt.datetime):
        return str(pd.Timestamp(v).tz_localize(None))
    return str(v) if isinstance(v, dt.date) else v.item() if hasattr(v, "item") else v


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and rows agree."""
    a = spark_df.toArrow()
    b = con.sql(sql).to_arrow_table()
    if sorted(a.column_names) != sorted(b.column_names):
        return f"columns {a.column_names} {b.column_names}"
    cols = sorted(a.column_names)
    rows = lambda t: sorted(map(repr, (tuple(plain(v) for v in r) for r in zip(*(t.column(c).to_pylist() for c in cols))))) if t.num_rows else []
    x, y = rows(a), rows(b)
    if x != y:
        bad = [(p, q) for p, q in zip(x, y) if p != q][:2]
        return f"{len(x)} rows, {len(y)} expected; {bad}"
    kinds = [(c, a.schema.field(c).type, b.schema.field(c).type) for c in cols if str(a.schema.field(c).type).split("[")[0] != str(b.schema.field(c).type).split("[")[0]]
    return f"types {kinds}" if kinds else ""
