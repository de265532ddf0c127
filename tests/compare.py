"""Compares a query's rows with those of SQL over the same Parquet files."""

import glob
import os


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    other = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert own == other
