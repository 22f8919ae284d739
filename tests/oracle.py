"""Comparing a DataFrame with DuckDB's answer on the same tables."""

import glob
import os

import duckdb
import numpy as np


def _plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_plain, x)) + "]"
    if x is None or str(x) in ("nan", "NaT", "<NA>", "None"):
        return "~"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{x:.6g}"
    return str(x)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted("|".join(map(_plain, r)) for r in pdf[cols].itertuples(index=False))


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(sql).df()
