"""Points in regions, by a plane sweep over polygon edges inside strips of longitude."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound on the sample that places the strips, rows a strip should hold, points swept at once at most, and those times edges.
SAMPLE_ROWS, STRIP_ROWS, STEP, CELLS = 100_000, 20_000, 256, 1_000_000

EDGE = "region bigint, x1 double, y1 double, x2 double, y2 double, size double"


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Edges ``region, x1, y1, x2, y2, size`` with x1 < x2 of rings given as vertices ``region, pos, x, y``.

    Each vertex leads to the next by ``pos`` and the last one to the first, whether it repeats it or not. Vertical edges never
    cross a vertical ray and are left out, as are vertices with a null. ``size`` is the area of the ring's bounding box.
    """
    w = Window.partitionBy("region").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    box = (F.max("x").over(whole) - F.min("x").over(whole)) * (F.max("y").over(whole) - F.min("y").over(whole))
    e = vertices.select("region", "pos", "x", "y").dropna().withColumns({"size": box, "nx": following("x"), "ny": following("y")}).filter("nx <> x")
    flip = F.col("x") > F.col("nx")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    return e.select("region", pick("x", "nx").alias("x1"), pick("y", "ny").alias("y1"), pick("nx", "x").alias("x2"), pick("ny", "y").alias("y2"), "size")


def _edge_strips(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A copy of every edge for each strip that it reaches."""
    for b in batches:
        x1, x2 = b.column("x1").to_numpy(), b.column("x2").to_numpy()
        lo, hi = np.searchsorted(cuts, x1, "right"), np.searchsorted(cuts, x2, "left")
        n = np.maximum(hi - lo, 0) + 1
        row = np.repeat(np.arange(len(n)), n)
        strip = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        part = b.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(strip), *part.columns], ["strip", *b.schema.names])


def sweep(px: np.ndarray, py: np.ndarray, edges: np.ndarray, region: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) for each region that holds the point: an odd number of its edges lies above.

    The sweep line goes through the points by x and keeps the edges it crosses, a bounded number of points times edges at a
    time; x1 <= x < x2 and an edge strictly above count, so shared borders belong to one side only. With ``first`` only
    the least of a point's regions is given.
    """
    order = np.argsort(px, kind="stable")
    by_start = np.lexsort((region, edges[:, 0])) if len(edges) else np.empty(0, np.int64)
    starts = edges[by_start, 0] if len(edges) else np.empty(0)
    active, nxt, i = np.empty(0, np.int64), 0, 0
    pts, regs = [], []
    while i < len(order):
        at = order[i : i + max(1, min(STEP, CELLS // max(len(active), 1)))]
        i += len(at)
        x, y = px[at], py[at]
        stop = int(np.searchsorted(starts, x[-1], "right"))
        active = np.concatenate([active, by_start[nxt:stop]])
        active = active[edges[active, 2] > x[0]]
        nxt = stop
        over = active[np.maximum(edges[active, 1], edges[active, 3]) > y.min()]
        if not len(over):
            continue
        live = over[np.argsort(region[over], kind="stable")]
        e, r = edges[live], region[live]
        height = e[:, 1] + (x[:, None] - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
        above = (e[:, 0] <= x[:, None]) & (x[:, None] < e[:, 2]) & (height > y[:, None])
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        odd = np.add.reduceat(above.astype(np.int32), begin, axis=1) % 2 == 1
        if first:
            p = np.flatnonzero(odd.any(axis=1))
            k = odd[p].argmax(axis=1)
        else:
            p, k = np.nonzero(odd)
        pts.append(at[p])
        regs.append(r[begin[k]])
    if not pts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(pts), np.concatenate(regs)


def _sweep_strip(pdf: pd.DataFrame, smallest: bool) -> pd.DataFrame:
    is_edge = pdf["region"].notna().to_numpy()
    e, p = pdf[is_edge], pdf[~is_edge]
    names = e[["region", "size"]].drop_duplicates().sort_values(["size", "region"])["region"].to_numpy().astype(np.int64)
    at = pd.Series(np.arange(len(names)), names).groupby(level=0).first()
    code = at.reindex(e["region"].astype(np.int64)).to_numpy().astype(np.int64)
    i, r = sweep(p["x1"].to_numpy(), p["y1"].to_numpy(), e[["x1", "y1", "x2", "y2"]].to_numpy(), code, smallest)
    return pd.DataFrame({"x": p["x1"].to_numpy()[i], "y": p["y1"].to_numpy()[i], "region": names[r]})


def points_in_regions(points: DataFrame, edges: DataFrame, strip_rows: int = STRIP_ROWS, smallest: bool = False, rows: int | None = None, sample: DataFrame | None = None) -> DataFrame:
    """``id, region`` for every point ``id, x, y`` (degrees) inside a region, by the even-odd rule in the plane.

    With ``smallest`` a point gets the one region of the least ``size``, ties by the smaller region; as a point lies in one
    strip, nothing more than that leaves it.

    Strips are cut at quantiles of a bounded sample of points and edges (or of ``sample``, a column ``x``, where that is cheaper,
    and of ``rows`` rows); an edge goes to each strip it reaches, a
    point to exactly one, and both are swept there. Distinct positions are swept once and joined back, so many
    points at one place cost one. Null positions lie nowhere; regions across the date line must be cut there.
    Repeated edges cancel each other, as the even-odd rule says; repeated points each come out.
    """
    spark = points.sparkSession
    pts, edg = points.select("id", "x", "y").dropna(), edges.select("region", "x1", "y1", "x2", "y2", "size").dropna().filter("x1 < x2")
    n = points.count() + edges.count() if rows is None else rows
    xs = sample.select("x").dropna() if sample is not None else pts.select("x").unionByName(edg.select(((F.col("x1") + F.col("x2")) / 2).alias("x")))
    frac = SAMPLE_ROWS / max(n, 1)
    seen = np.sort(np.array((xs if frac >= 1 else xs.sample(frac, 5)).toPandas()["x"], float))
    k = max(1, min(-(-n // strip_rows), SAMPLE_ROWS // 8))
    cuts = np.unique(np.quantile(seen, np.arange(1, k) / k)) if len(seen) and k > 1 else np.empty(0)
    shared = spark.sparkContext.broadcast(cuts)
    placed_edges = edg.mapInArrow(lambda it: _edge_strips(it, shared.value), f"strip bigint, {EDGE}")
    none = F.lit(None)
    places = pts.select("x", "y").distinct()
    as_edges = places.select(none.cast("bigint").alias("region"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), none.cast("double").alias("y2"), none.cast("double").alias("size"))
    placed_points = as_edges.mapInArrow(lambda it: _point_strips(it, shared.value), f"strip bigint, {EDGE}")
    found = placed_edges.unionByName(placed_points).groupBy("strip").applyInPandas(lambda pdf: _sweep_strip(pdf, smallest), "x double, y double, region bigint")
    return pts.join(found, ["x", "y"]).select("id", "region")


def _point_strips(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        strip = np.searchsorted(cuts, b.column("x1").to_numpy(), "right")
        yield pa.RecordBatch.from_arrays([pa.array(strip), *b.columns], ["strip", *b.schema.names])
