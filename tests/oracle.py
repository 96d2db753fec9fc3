"""Runs a query and its SQL side by side."""

import glob
import os

import duckdb


def engine(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = relation.select(*(f'"{c}"' for c in columns)).fetchall()
    assert mine == sorted(tuple(map(plain, r)) for r in theirs)
