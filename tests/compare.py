"""Rows of a query and of its SQL in one form, so that they can be compared."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(norm, x)) + "]"
    return str(x)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql: str, folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())
