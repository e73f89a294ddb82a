"""Rows of a query and of its SQL on the smallest tables, in one form."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def rows_of(query, spark):
    df = query(spark, SF)
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)


def rows_of_sql(sql):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
