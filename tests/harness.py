"""Side-by-side comparison of a Spark plan and its SQL text on the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

from veil.plans.derived import BASE


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        raise TypeError("decimal in a result")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 5) + 0.0:.5f}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return "NULL" if v is None else str(v)


def family(t: str) -> str:
    t = t.lower()
    if t.startswith(("bigint", "int", "long", "smallint", "tinyint", "hugeint")):
        return "hugeint" if t == "hugeint" else "int"
    if t.startswith(("double", "float")):
        return "float"
    if t.startswith(("varchar", "string")):
        return "string"
    if t.startswith("bool"):
        return "bool"
    return t.split("(")[0].split(" ")[0]


def compare(spark_df, con, sql: str) -> int:
    """Raise AssertionError on any difference; return the row count."""
    cols = sorted(spark_df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    oracle_rows = rel.fetchall()
    types = {r[0]: family(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert cols == sorted(names), f"columns {cols} vs {sorted(names)}"
    spark_types = {f.name: family(f.dataType.simpleString()) for f in spark_df.schema.fields}
    assert spark_types == types, f"types differ: {[(c, spark_types[c], types[c]) for c in cols if spark_types[c] != types[c]]}"
    left = sorted(tuple(cell(r[c]) for c in cols) for r in spark_df.collect())
    at = [names.index(c) for c in cols]
    right = sorted(tuple(cell(r[i]) for i in at) for r in oracle_rows)
    assert len(left) == len(right), f"{len(left)} rows vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    assert not bad, f"{len(bad)} of {len(left)} rows differ, first: {cols} {bad[0]}"
    return len(left)
