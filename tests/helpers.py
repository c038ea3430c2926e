"""Comparison helpers shared by the tests."""

import datetime as dt
import math
from decimal import Decimal

import duckdb

from reelpulse.sources.tables import TEST_TABLES


def norm(v, digits=12):
    if v is None:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.{digits}g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    return v


def canon(cols, rows, digits=12):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def duck_rows(con, sql):
    res = con.execute(sql)
    return [d[0] for d in res.description], res.fetchall()


def same(a, b, digits=12):
    (ca, ra), (cb, rb) = a, b
    return sorted(ca) == sorted(cb) and canon(ca, ra, digits) == canon(cb, rb, digits)
