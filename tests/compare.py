"""Compares a query's rows with its SQL's, by column name and as bags."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return str(v)[:26]
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def _key(row):
    return tuple((x is None, "" if isinstance(x, (int, float)) else str(type(x)), 0 if x is None else x) for x in row)


def expected(sql: str, folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=_key)


def found(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=_key)
