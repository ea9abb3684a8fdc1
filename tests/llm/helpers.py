"""Brute-force versions for the tests."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.01"


def have_data() -> bool:
    return os.path.isdir(DATA)


def duck(**tables):
    """A DuckDB connection with the given data frames, or the tables of DATA, as views."""
    con = duckdb.connect()
    if tables:
        for name, df in tables.items():
            con.register(name, df)
    else:
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df: pd.DataFrame, columns=None) -> list[tuple]:
    """Rows in a fixed order, with missing values alike and doubles to nine digits."""
    columns = sorted(columns or df.columns)

    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return str(list(v))
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))
