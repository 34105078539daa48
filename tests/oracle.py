"""Comparison of a query's rows with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if x != x else str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return str([cell(v) for v in x])
    return "NULL" if x is None else str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in df.collect())


def duck_rows(c, sql):
    got = c.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(cell(r[i]) for i in at) for r in got.fetchall())
