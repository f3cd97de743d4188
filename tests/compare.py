"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, query, sql, sf_dir):
    """Empty if columns and rows agree."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    frame = query(spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    if got[0] != want[0]:
        return [("columns", got[0], want[0])]
    if len(got[1]) != len(want[1]):
        return [("rows", len(got[1]), len(want[1]), got[1][:2], want[1][:2])]
    return [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b][:3]
