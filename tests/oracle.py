"""Run a registered query and its SQL form on the same tables and compare the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else v
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def compare(spark, con, f, sql: str, folder: str = DATA) -> str | None:
    """None if the rows agree, else what differs."""
    df = f(spark, folder)
    got = rows_of(df.columns, df.collect())
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    want = rows_of(names, done.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = list((got - want).elements()), list((want - got).elements())
        return f"{sum(got.values())} rows and {sum(want.values())}; only Spark {len(a)}: {sorted(map(str, a))[:2]}; only SQL {len(b)}: {sorted(map(str, b))[:2]}"
    return None
