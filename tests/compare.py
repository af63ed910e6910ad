"""Spark rows against DuckDB rows."""

import os

import duckdb
import numpy as np
import pandas as pd


def connection(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def _cell(x) -> str:
    if isinstance(x, (list, np.ndarray)):
        return str([_cell(y) for y in x])
    if x is None or x is pd.NA or (np.isscalar(x) and pd.isna(x)) or x is pd.NaT:
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return f"{float(x):.9g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
