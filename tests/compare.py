"""A query's rows against its SQL in DuckDB, without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(round(v, 6) + 0.0))
    return (1, str(v))


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in names]
    assert len(result.description) == len(names)
    assert got == sorted(tuple(value(r[i]) for i in at) for r in result.fetchall())
