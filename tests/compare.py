"""Runs queries in Spark and their SQL in DuckDB over the same tables and compares the rows."""

import glob
import os

import duckdb
import pandas as pd


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c.execute(sql).df()


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        return round(float(v), 5)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} and {sorted(want.columns)}"]
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows", *[str(x) for x in (set(map(repr, a)) ^ set(map(repr, b)))][:4]]
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in x] != [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in y]][:4]
