"""Runs a registered query and its SQL counterpart side by side and compares all rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio"):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return str(value)


def compare(spark, name: str, query, sql: str, sf_dir: str = SF_DIR) -> str | None:
    """None when both agree, else a description of the difference."""
    result = query(spark, sf_dir)
    columns = sorted(result.columns)
    got = Counter(tuple(canonical(v) for v in row) for row in result.select(
        *[f"`{c}`" for c in columns]).collect())
    relation = connect(sf_dir).sql(sql)
    if sorted(relation.columns) != columns:
        return f"{name}: columns {columns} != {sorted(relation.columns)}"
    order = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(canonical(row[i]) for i in order) for row in relation.fetchall())
    if got == want:
        return None if got else f"{name}: both empty"
    return (f"{name}: {sum(got.values())} rows vs {sum(want.values())}; only here "
            f"{list((got - want).items())[:3]}; only oracle {list((want - got).items())[:3]}")
