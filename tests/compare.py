"""Runs registered queries in Spark and their SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else round(float(x), 5) if isinstance(x, float) else int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else x
    return sorted((tuple(cell(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None)), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", "") for x in r))
