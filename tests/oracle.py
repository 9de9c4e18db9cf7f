"""Comparing a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6))
    return str(value).removesuffix("+00:00")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(spark_frame, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    assert sorted(spark_frame.columns) == sorted(names)
    assert rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()]) == expected
