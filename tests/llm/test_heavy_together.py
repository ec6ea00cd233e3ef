"""Heavy hitters and co-occurrence against exact counts."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamap.llm import heavy, together


def test_heavy_hitters_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [("a", f"x{int(z)}", 1) for z in r.zipf(1.3, 30000)] + [("b", "half", 500), ("b", "ten", 100)] + [("b", f"r{i}", 1) for i in range(400)]
    rows += [("b", None, 9), (None, "x", 9), ("b", "n", None)]
    d = spark.createDataFrame(rows, "field_name string, item string, weight bigint").withColumn("h", F.lit("clash")).repartition(5)
    got = {(x.field_name, x.item): (x.n, x.n_group) for x in heavy.heavy_hitters(d, 0.01).collect()}
    exact = Counter()
    for f, i, w in rows:
        if None not in (f, i, w):
            exact[f, i] += w
    total = Counter()
    for (f, _), n in exact.items():
        total[f] += n
    assert got == {k: (n, total[k[0]]) for k, n in exact.items() if n >= 0.01 * total[k[0]]}


def test_heavy_hitters_with_a_tiny_sketch_lose_nothing_heavy(spark):
    rows = [("f", "third", 3000)] + [("f", f"tie{i}", 200) for i in range(10)] + [("f", f"u{i}", 1) for i in range(4000)]
    d = spark.createDataFrame(rows, "field_name string, item string, weight bigint")
    got = heavy.heavy_hitters(d, 0.02, heavy.Hierarchy(width=512)).collect()
    assert {r.item for r in got} == {"third", *(f"tie{i}" for i in range(10))}


def test_heavy_hitters_of_nothing(spark):
    assert heavy.heavy_hitters(spark.createDataFrame([], "field_name string, item string, weight bigint")).count() == 0


def test_one_item_only(spark):
    assert [tuple(r) for r in heavy.heavy_hitters(spark.createDataFrame([("f", "", 1)], "field_name string, item string, weight bigint")).collect()] == [("f", "", 1, 1)]


def test_any_number_of_groups(spark, monkeypatch):
    rows = [(f"g{i % 150}", f"x{i % 3}", 1) for i in range(900)]
    d = spark.createDataFrame(rows, "field_name string, item string, weight bigint").coalesce(2)
    got = heavy.heavy_hitters(d, 0.3, heavy.Hierarchy(width=256)).collect()
    assert len(got) == len({(g, x) for g, x, _ in rows}) and {r.n_group for r in got} == {6}


def test_rare_shares():
    """The sketch grows as the share shrinks, and what no bounded sketch can tell is refused."""
    r = np.random.default_rng(6)
    x = np.minimum(r.zipf(1.1, 400_000), 200_000_000).astype(np.uint64)
    kinds, n = np.unique(x, return_counts=True)
    h = heavy._mix(kinds, 99)
    for share in (1e-2, 1e-3, 1e-4):
        shape = heavy.Hierarchy.of(share)
        flat = np.zeros(shape.slots, np.int64)
        heavy._add(flat, h, n, shape)
        got = heavy.descend(flat, int(n.sum()), share, shape)
        assert set((h[n >= share * n.sum()] >> np.uint64(24)).tolist()) <= set(got.tolist()) and len(got) <= 2 / share
    assert heavy.Hierarchy.of(1e-2).width < heavy.Hierarchy.of(1e-3).width
    for share in (1e-6, 0, 2):
        with pytest.raises(ValueError):
            heavy.Hierarchy.of(share)


def llr(k, a, b, n):
    def part(x, row, col):
        return x * math.log(x * n / (row * col)) if x else 0.0

    return 2 * (part(k, a, b) + part(a - k, a, n - b) + part(b - k, n - a, b) + part(n - a - b + k, n - a, n - b))


@pytest.mark.parametrize("limit", [1, together.STRIPE_ENTRIES])
def test_pairs_against_brute_force(spark, limit, monkeypatch):
    r = np.random.default_rng(4)
    records = [[f"k{int(x)}" for x in r.integers(0, 12, r.integers(0, 7))] for _ in range(400)] + [None, [], [None], ["only"], ["k1", None, "k1"]]
    d = spark.createDataFrame([(x, 1) for x in records], "items array<string>, n int").repartition(3)
    sets = [{y for y in x or [] if y is not None} for x in records]
    sets = [s for s in sets if s]
    n, one = len(sets), Counter(k for s in sets for k in s)
    both = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    if limit == 1:
        import pyarrow as pa

        merged = Counter()
        batches = [pa.RecordBatch.from_arrays([pa.array([sorted(s) for s in sets[i : i + 50]], pa.list_(pa.string()))], ["items"]) for i in range(0, n, 50)]
        parts = [b for pairs in (1, 5, 1000) for b in together._stripes(iter(batches), limit=1, pairs=pairs)]
        for b in parts:
            for row in b.to_pylist():
                for other, c in zip(row["near"], row["n"]):
                    merged[row["item"], other] += c
        merged = Counter({k: c // 3 for k, c in merged.items()})
        rows = sorted((r for b in parts for r in b.to_pylist()), key=lambda r: str(r["item"]))
        again = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in (("item", pa.string()), ("near", pa.list_(pa.string())), ("n", pa.list_(pa.int64())))] + [pa.array([0] * len(rows))], ["item", "near", "n", "segment"])
        for cap in (1, 10**6):
            total = {(r["item"], o): c for b in together._merge(iter([again.slice(0, 7), again.slice(7)]), cap) for r in b.to_pylist() for o, c in zip(r["near"], r["n"])}
            assert total == {k: 3 * c for k, c in merged.items()}
        assert merged == Counter({(None, None): n, **{(k, k): c for k, c in one.items()}, **both})
        return
    got = {(x.key_a, x.key_b): x for x in together.co_occurrence(d).collect()}
    assert {k: x.n_ab for k, x in got.items()} == dict(both)
    for (a, b), x in got.items():
        assert (x.n_a, x.n_b, x.n) == (one[a], one[b], n)
        assert x.llr == pytest.approx(llr(x.n_ab, x.n_a, x.n_b, n), abs=1e-8) and x.lift == pytest.approx(x.n_ab * n / (x.n_a * x.n_b))


def test_large_records_are_expanded_piece_by_piece():
    codes, offsets = np.arange(3000), np.array([0, 0, 2000, 2000, 3000])
    got = list(together._pairs(offsets, codes, 100_000))
    assert max(len(a) for a, _ in got) <= 100_000 and sum(len(a) for a, _ in got) == 2000 * 2001 // 2 + 1000 * 1001 // 2
    a, b = (np.concatenate(x) for x in zip(*got))
    assert (a <= b).all() and len(np.unique(a * 3000 + b)) == len(a) and ((a < 2000) == (b < 2000)).all()


def test_pairs_of_nothing(spark):
    assert together.co_occurrence(spark.createDataFrame([], "items array<string>")).count() == 0
    assert together.co_occurrence(spark.createDataFrame([([],), (None,)], "items array<string>")).count() == 0
