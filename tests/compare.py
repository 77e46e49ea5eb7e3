"""Run registered queries in Spark and their SQL in DuckDB and compare rows as multisets."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float):
        return repr(v)
    return v


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple((_value(r[k]), type(r[k]).__name__) for k in order) for r in rows)


def compare(spark_df, con, sql: str) -> tuple[int, int, list, list]:
    """(spark rows, duckdb rows, sample only in spark, sample only in duckdb)."""
    names = spark_df.columns
    ours = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    duck_names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(duck_names):
        return len(ours), len(theirs), [sorted(names)], [sorted(duck_names)]
    a, b = _bag(ours, names), _bag(theirs, duck_names)
    return len(ours), len(theirs), list((a - b).items())[:3], list((b - a).items())[:3]
