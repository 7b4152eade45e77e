"""Compare a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from quillon.session import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime().replace(tzinfo=None)
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def difference(query, sql: str, spark, sf_dir: str, con) -> str | None:
    mine, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows, such as {wrong[0]}" if wrong else None
