"""Runs SQL in DuckDB over the tables and compares rows without order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def sql_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 5)
        return int(v) if isinstance(v, np.integer) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
