"""Comparison of a Spark result with DuckDB's over the same tables."""

import glob
import os
from collections import Counter

import duckdb


def number(v):
    if v is None or str(v) in ("<NA>", "NaT") or isinstance(v, float) and v != v:
        return None
    numeric = isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "iufb"
    return round(float(v), 9) if numeric else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(map(number, r)) for r in df[cols].astype(object).values.tolist())


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = rows(query(spark, sf).toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1], ((a[1] - b[1]).most_common(3), (b[1] - a[1]).most_common(3))
