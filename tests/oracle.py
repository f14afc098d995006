"""Compares a query's rows with those of its SQL on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v if v is None or isinstance(v, (int, str, bool)) else float(v) if hasattr(v, "as_tuple") else v

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def check(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = query(spark, folder)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())
