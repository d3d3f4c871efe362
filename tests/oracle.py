"""Compare a query with its SQL on DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.sql(f"create view {f[:-8]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(str(type(v)), str(v)) for v in r])


def check(spark, name: str, query, sql: str, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    r = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(r.columns), name
    assert rows_of(df.columns, df.collect()) == rows_of(r.columns, r.fetchall()), name
