"""Compares a Spark result with DuckDB's on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{folder}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def same(df, con, sql):
    cur = con.execute(sql)
    want_cols, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(want_cols)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == rows(want_cols, want)
