"""Compare registered queries with their SQL, row by row."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(source):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, int):
        return float(x)
    return str(x)


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def difference(df, sql: str, con) -> str:
    """What differs, or an empty text."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:2]}; only theirs {list((want - got).items())[:2]}"
