"""Run a registered query on Spark and its SQL on DuckDB, and compare the two results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), bad[:3])
    types = {n: str(t) for n, t in zip(names, [d[1] for d in rel.description])}
    return len(got), dict(df.dtypes), types
