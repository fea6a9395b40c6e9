"""Rows of a Spark query and of its SQL as comparable text."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return str(v)


def rows_of(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, duck, sf, query, sql):
    df = query(spark, sf)
    got = df.collect()
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, want)
