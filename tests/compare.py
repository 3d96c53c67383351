"""Rows of a Spark result and of DuckDB SQL in one comparable form."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 7) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return repr(v)


def spark_rows(df):
    return sorted(tuple(norm(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


def sql_rows(con, sql):
    r = con.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return sorted(r.columns), sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())
