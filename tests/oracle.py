"""Runs a query and its SQL on the same tables and compares rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    result = connect(sf_dir).execute(sql)
    given = [d[0] for d in result.description]
    theirs = sorted(tuple(plain(dict(zip(given, r))[n]) for n in names) for r in result.fetchall())
    assert sorted(given) == names
    assert ours == theirs
    return len(ours)
