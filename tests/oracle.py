"""Compare a query with its SQL, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import math
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return str(value)


def rows_of_sql(c, text: str):
    r = c.execute(text)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(x[n]) for n in names) for x in df.collect())
