"""Spark results held against DuckDB's on the smallest tables."""

import glob
import math
import os
from functools import lru_cache

import duckdb

DATA = "/root/testdata/sf0.001"


@lru_cache(maxsize=1)
def connection():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str([canon(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def check(spark, query, text):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    want = connection().sql(text)
    names = sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert cols == names
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in want.fetchall())
