"""Copies of the smallest tables: empty, and with a row of nulls and columns of clashing names."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

from tests.oracle import TESTDATA

CLASH = ["k", "v", "s", "ms", "vis", "tags", "item", "items", "n", "b", "head", "ids", "score", "leaf", "own", "weight", "value", "attr", "pos", "kind", "date_granularity", "granularity", "_p", "_top", "missing_id", "month_key"]


def tables():
    return [f for f in os.listdir(f"{TESTDATA}/sf0.001") if f.endswith(".parquet")]


def empty(folder):
    for f in tables():
        pq.write_table(pq.read_table(f"{TESTDATA}/sf0.001/{f}").slice(0, 0), f"{folder}/{f}")
    return str(folder)


def dirty(folder):
    for f in tables():
        t = pq.read_table(f"{TESTDATA}/sf0.001/{f}")
        nulls = pa.Table.from_arrays([pa.nulls(1, c.type) for c in t.columns], names=t.column_names)
        t = pa.concat_tables([t, nulls])
        for c in CLASH:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["clash"] * t.num_rows))
        pq.write_table(t, f"{folder}/{f}")
    return str(folder)


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))
