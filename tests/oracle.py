"""Compare a query's rows with its SQL's, whatever their order."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "__int__") and not isinstance(v, (str, bool)):
        return str(int(v))
    return str(v)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def same(query, sql, spark, sf_dir):
    df = query(spark, sf_dir)
    columns, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    have = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [columns.index(c) for c in order]
    wanted = Counter(tuple(_plain(r[i]) for i in at) for r in want)
    assert have == wanted, (list((have - wanted))[:3], list((wanted - have))[:3])
    return sum(have.values())
