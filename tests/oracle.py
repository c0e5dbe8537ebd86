"""Compares a query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return tuple(map(_plain, value)) if isinstance(value, list | tuple) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark, query, sql, sf_dir):
    made = query(spark, sf_dir)
    cursor = duck(sf_dir).execute(sql)
    assert rows_of(made.columns, made.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
