"""Compares a query's rows with its oracle SQL in DuckDB."""

import datetime
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows_of(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in arrow.to_pylist())


def connect(base):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{base}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, base, query, sql):
    spark_rows = rows_of(query(spark, base).toArrow())
    duck_rows = rows_of(connect(base).sql(sql).to_arrow_table())
    assert spark_rows[0] == duck_rows[0]
    assert spark_rows[1] == duck_rows[1]
