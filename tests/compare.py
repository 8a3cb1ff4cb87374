"""Side-by-side run of a registered query and its SQL counterpart."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else (int(v) if v.is_integer() else v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(spark, con, sf_dir: str, fn, sql: str | None, limit: int = 3) -> tuple[int, list[str]]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return len(mine), []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(mine), [f"columns {cols} != {sorted(names)}"]
    at = [names.index(c) for c in cols]
    theirs = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
    if a == b:
        return len(mine), []
    out = [f"rows {len(a)} vs {len(b)}; columns {cols}"]
    sa, sb = set(map(repr, a)), set(map(repr, b))
    out += [f"  spark only: {x[:400]}" for x in sorted(sa - sb)[:limit]]
    out += [f"  sql only:   {x[:400]}" for x in sorted(sb - sa)[:limit]]
    return len(mine), out
