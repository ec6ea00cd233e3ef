"""Points in polygons against a ray cast for each pair."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratamap.operators import regions


def inside(x, y, edges):
    return sum(x1 <= x < x2 and y1 + (x - x1) * (y2 - y1) / (x2 - x1) > y for x1, y1, x2, y2 in edges) % 2 == 1


def edges_of(ring):
    out = []
    for (x, y), (nx, ny) in zip(ring, ring[1:]):
        if x != nx:
            out.append((x, y, nx, ny) if x < nx else (nx, ny, x, y))
    return out


coord = st.integers(0, 20).map(float)
ring = st.lists(st.tuples(coord, coord), min_size=3, max_size=8).map(lambda r: [*r, r[0]])


@settings(max_examples=150, deadline=None)
@given(st.lists(ring, max_size=6), st.lists(st.tuples(st.floats(0, 20), st.floats(0, 20)), max_size=40))
def test_sweep(rings, points):
    e = [(*x, i) for i, r in enumerate(rings) for x in edges_of(r)]
    arr = np.array(e, float).reshape(-1, 5)
    p, r = regions.sweep(np.array([x for x, _ in points]), np.array([y for _, y in points]), arr[:, :4], arr[:, 4].astype(np.int64))
    want = {(i, j) for i, (x, y) in enumerate(points) for j, q in enumerate(rings) if inside(x, y, edges_of(q))}
    assert set(zip(p.tolist(), r.tolist())) == want and len(p) == len(want)


def test_sweep_in_small_steps(monkeypatch):
    r = np.random.default_rng(3)
    e = np.sort(r.uniform(0, 20, (60, 2)), axis=1)
    edges, of = np.stack([e[:, 0], r.uniform(0, 20, 60), e[:, 1], r.uniform(0, 20, 60)], axis=1), np.arange(60) // 4
    x, y = r.uniform(0, 20, (2, 500))
    whole = set(zip(*(a.tolist() for a in regions.sweep(x, y, edges, of))))
    least = dict(sorted(whole, reverse=True))
    monkeypatch.setattr(regions, "CELLS", 100)
    assert set(zip(*(a.tolist() for a in regions.sweep(x, y, edges, of)))) == whole
    assert dict(zip(*(a.tolist() for a in regions.sweep(x, y, edges, of, True)))) == least


def test_points_in_regions(spark):
    r = np.random.default_rng(8)
    rings = {}
    for i in range(25):
        n, cx, cy = int(r.integers(3, 9)), r.uniform(-150, 150), r.uniform(-60, 60)
        a = np.sort(r.uniform(0, 2 * np.pi, n))
        pts = [(float(cx + k * np.cos(t)), float(cy + k * np.sin(t))) for t, k in zip(a, r.uniform(5, 40, n))]
        rings[i] = [*pts, pts[0]]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(-170, 170, 400), r.uniform(-80, 80, 400)))]
    points += [(500 + i, *points[0][1:]) for i in range(5)] + [(600, None, 1.0), (601, 1.0, None)]
    v = spark.createDataFrame([(i, p, x, y) for i, q in rings.items() for p, (x, y) in enumerate(q)] + [(99, 0, None, 1.0), (98, 0, 1.0, 1.0)], "region bigint, pos int, x double, y double").withColumn("nx", F.lit(0))
    d = spark.createDataFrame(points, "id bigint, x double, y double").withColumn("region", F.lit("clash"))
    want = sorted((i, j) for i, x, y in points if x is not None and y is not None for j, q in rings.items() if inside(x, y, edges_of(q)))
    assert len(want) > 100
    for rows in (30, 100000):
        assert sorted(map(tuple, regions.points_in_regions(d, regions.ring_edges(v), rows).collect())) == want
    box = {i: (max(x for x, _ in q) - min(x for x, _ in q)) * (max(y for _, y in q) - min(y for _, y in q)) for i, q in rings.items()}
    least = sorted((i, min((j for k, j in want if k == i), key=lambda j: (box[j], j))) for i in {i for i, _ in want})
    open_ = v.filter("pos > 0")  # rings whose last vertex does not repeat the first are closed, too
    assert sorted(map(tuple, regions.points_in_regions(d, regions.ring_edges(open_), 30, smallest=True).collect())) == least
    e = regions.ring_edges(v)
    assert regions.points_in_regions(d.limit(0), e).count() == 0 and regions.points_in_regions(d, e.limit(0)).count() == 0
