"""Compares a query with its SQL on a folder of tables."""

import math
import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, np.ndarray):
        return tuple(map(_plain, v.tolist()))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


def rows(frame):
    return sorted((tuple(map(_plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def same(spark, query, sql, folder=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
