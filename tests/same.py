"""Spark results against DuckDB's, without regard to the order of rows."""

import glob
import os

import duckdb
import pandas as pd


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    cols = sorted(found.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (found, wanted))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)
