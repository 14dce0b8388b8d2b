"""Comparison of a registered query with its DuckDB SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf: str = SF, tables=TABLES):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for t in tables:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, fn, sql, sf: str = SF, tables=TABLES):
    df = fn(spark, sf)
    cols = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    r = connect(sf, tables).sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    theirs = [tuple(plain(x[i]) for i in at) for x in r.fetchall()]
    assert ordered(ours) == ordered(theirs)
