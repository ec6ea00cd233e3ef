"""Comparison of a query with its SQL on the same Parquet tables."""

import os
from collections import Counter

import duckdb

TESTDATA = os.environ.get("STRATAMAP_TESTDATA", "/root/testdata")


def rows_of(frame):
    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return cols, Counter(tuple(None if x is None or x != x else str(x) for x in r) for r in f.where(frame[cols].notna(), None).itertuples(index=False))


def compare(spark, query, sql, sf="sf0.001"):
    d = f"{TESTDATA}/{sf}"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{d}/{f}')")
    got, want = rows_of(query(spark, d).toPandas()), rows_of(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
    return sum(got[1].values())
