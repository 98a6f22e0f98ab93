"""Order-insensitive comparison of a query with its oracle."""

import datetime
import decimal


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def same(df, sql, duck):
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert got == want
