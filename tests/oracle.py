"""Compares queries with their SQL, as sorted rows with columns by name."""

from __future__ import annotations

import math

import duckdb

from folioforge.session import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    wanted = rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    assert len(got) == len(wanted), (len(got), len(wanted))
    different = [(a, b) for a, b in zip(got, wanted, strict=True) if a != b]
    assert not different, different[:2]
    kinds = dict(df.dtypes)
    for d in con.execute(f"DESCRIBE {sql}").fetchall():
        want = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(kinds[d[0]], kinds[d[0]])
        assert d[1] == want, (d[0], d[1], kinds[d[0]])
    return len(got)
