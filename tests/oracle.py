"""Run a query and its SQL side by side and compare them as bags of rows, columns by name."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x


def difference(df, con, sql: str) -> str:
    """Empty if the rows agree; else what differs."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return "" if got else "no rows"
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
