"""Compare a query with its oracle: rows without order, doubles to nine digits."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(f"{v:.9g}")) if not v.is_integer() or math.isinf(v) else int(v)
    return v


def rows(names: list[str], data: list) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in at) for r in data), key=repr)


def differences(df, con, sql: str) -> str:
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine == theirs:
        return ""
    a, b = [x for x in mine if x not in theirs][:2], [x for x in theirs if x not in mine][:2]
    return f"{len(mine)} and {len(theirs)} rows; only here {a}; only there {b}; columns {sorted(names)}"
