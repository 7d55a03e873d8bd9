"""Rows of a query and of its DuckDB twin, in a form that can be compared."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, str | bool | int):
        return v
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def same(df, con, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = Counter(tuple(plain(x) for x in r) for r in con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql})").fetchall())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
