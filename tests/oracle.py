"""Runs a query and its SQL on the same tables and compares rows."""

import math

import duckdb
import pandas as pd

from docloom.session import TABLES


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(df) -> list[tuple]:
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
                out.append(None)
            elif isinstance(v, float):
                out.append(int(v) if v.is_integer() else round(v, 8))
            elif hasattr(v, "isoformat"):
                out.append(str(v)[:26])
            else:
                out.append(v.item() if hasattr(v, "item") else v)
        rows.append(tuple(out))
    return sorted(rows, key=repr)
