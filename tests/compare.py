"""Runs a registered query and its SQL side by side."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bytearray | bytes):
        return bytes(v)
    return (type(v).__name__, str(v))


def same_rows(spark, query, sql):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    df = query(spark, SF)
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    rows = lambda found: sorted(tuple(map(value, r)) for r in found)
    assert rows(df.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
