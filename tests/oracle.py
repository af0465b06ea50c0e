"""Comparison of a Spark result with DuckDB's on the same parquet tables."""

import glob
import os

import pandas as pd

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if hasattr(v, "__len__") and not isinstance(v, (str, dict)):
        return str(list(v))
    if v is None or v is pd.NaT or v != v:
        return None
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(table):
    df = table.to_pandas()
    names = sorted(df.columns)
    return names, sorted(str(tuple(map(_cell, r))) for r in df[names].itertuples(index=False))
