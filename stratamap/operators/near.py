"""Points near other points, and points in regions."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: mean radius of the sphere in metres.
EARTH_M = 6_371_008.8
#: Bounds on the sample that fits the k-d splits (more leaves ask for more points), and the positions a leaf should hold.
SAMPLE_ROWS, MOST_SAMPLED, LEAF_ROWS = 100_000, 2_000_000, 20_000
BUCKET = 8
#: Points of one position that are expanded together; positions with more are cut into such blocks. A position counts as
#: crowded from so many points on, but never are more than MOST_CROWDED positions crowded, so that their list can be broadcast.
BLOCK, MOST_CROWDED = 2_000, 100_000


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Degrees to points of the unit sphere, shape (n, 3)."""
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def chord(metres: float) -> float:
    """Chord of the unit sphere under a great circle arc, widened a little; the exact test follows."""
    return 2 * math.sin(min(metres / EARTH_M, math.pi) / 2) * (1 + 1e-9) + 1e-12


def haversine_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


@dataclass(frozen=True)
class Splits:
    """A k-d split tree: per node its dimension (-1 at a leaf), threshold and two children."""

    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray


def fit_splits(xyz: np.ndarray, leaves: int, margin: float, most: float = math.inf) -> Splits:
    """Split the fullest cell at its median while there are fewer than ``leaves`` and it is wider than a few margins.

    Halos so stay small against their cells. Only cells of more than ``most`` sampled points are split on below that width,
    since their points have so many neighbours each that copies in halos weigh little. A place that many points share is
    never split in vain.
    """
    nodes: list[list] = [[-1, 0.0, -1, -1]]
    xyz = np.unique(xyz, axis=0)
    todo, narrow, made = [(-len(xyz), 0, xyz)], [], 1
    while todo or narrow:
        dense = not todo
        size, node, pts = heapq.heappop(narrow if dense else todo)
        if dense and (-size < 4 or -size <= most):
            break
        if not dense and (-size < 4 or made >= leaves):
            narrow += [x for x in [(size, node, pts), *todo] if -x[0] > most]
            heapq.heapify(narrow)
            todo = []
            continue
        width = pts.max(axis=0) - pts.min(axis=0)
        d = int(width.argmax())
        low = pts[:, d] < np.median(pts[:, d])
        if not low.any():
            continue
        if not dense and width[d] <= 8 * margin:
            heapq.heappush(narrow, (size, node, pts))
            continue
        m = float(pts[low, d].max() + pts[~low, d].min()) / 2  # between two values, so that no point lies on the cut
        nodes[node] = [d, m, len(nodes), len(nodes) + 1]
        for part in (pts[low], pts[~low]):
            heapq.heappush(narrow if dense else todo, (-len(part), len(nodes), part))
            nodes.append([-1, 0.0, -1, -1])
        made += 1
    dim, at, left, right = zip(*nodes)
    return Splits(np.array(dim), np.array(at), np.array(left), np.array(right))


def place(xyz: np.ndarray, splits: Splits, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, owner) of every point and of its copies in each leaf closer than the margin."""
    rows, nodes, own = np.arange(len(xyz)), np.zeros(len(xyz), np.int64), np.ones(len(xyz), bool)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        d = splits.dim[nodes]
        leaf = d < 0
        done.append((rows[leaf], nodes[leaf], own[leaf]))
        rows, nodes, own, d = rows[~leaf], nodes[~leaf], own[~leaf], d[~leaf]
        x, c = xyz[rows, d], splits.at[nodes]
        low, high = x < c + margin, x >= c - margin
        rows, own, nodes = (
            np.concatenate([rows[low], rows[high]]),
            np.concatenate([(own & (x < c))[low], (own & (x >= c))[high]]),
            np.concatenate([splits.left[nodes[low]], splits.right[nodes[high]]]),
        )
    return tuple(np.concatenate(z) for z in zip(*done)) if done else (rows, nodes, own)


def kd_pairs(xyz: np.ndarray, radius: float, own: np.ndarray | None = None, chunk: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j within the chord radius, by a balanced k-d tree joined with itself, a bounded number at once.

    With ``own`` pairs without a point of it may be left out. Both sides descend together: a pair of cells goes on only while their boxes are within the radius, so
    the work follows the number of near cells, never the square of the points.
    """
    n = len(xyz)
    if n < 2:
        return
    depth = max(0, math.ceil(math.log2(n / BUCKET)))
    size = -(-n // (1 << depth))
    total = size << depth
    order = np.concatenate([np.arange(n), np.full(total - n, -1)])
    pts = np.concatenate([xyz, np.full((total - n, 3), np.inf)])
    for level in range(depth):
        cells = 1 << level
        p = pts.reshape(cells, -1, 3)
        finite = np.isfinite(p[..., 0])
        lo = np.where(finite[..., None], p, np.inf).min(axis=1)
        hi = np.where(finite[..., None], p, -np.inf).max(axis=1)
        d = np.where(np.isfinite(hi - lo), hi - lo, -1).argmax(axis=1)
        key = np.take_along_axis(p, d[:, None, None], axis=2)[..., 0]
        pick = np.argpartition(key, key.shape[1] // 2, axis=1) if key.shape[1] > 1 else np.zeros_like(key, int)
        flat = (pick + (np.arange(cells) * key.shape[1])[:, None]).ravel()
        pts, order = pts[flat], order[flat]
    mine = np.append(np.ones(n, bool) if own is None else own, False)[order].reshape(1 << depth, size).any(axis=1)
    boxes, owned = [], [mine]
    for _ in range(depth):
        owned.append(owned[-1][0::2] | owned[-1][1::2])
    owned.reverse()
    lo = hi = None
    for level in range(depth, -1, -1):
        if lo is None:
            p = pts.reshape(1 << depth, size, 3)
            fin = np.isfinite(p[..., :1])
            lo, hi = np.where(fin, p, np.inf).min(axis=1), np.where(fin, p, -np.inf).max(axis=1)
        else:
            lo, hi = np.minimum(lo[0::2], lo[1::2]), np.maximum(hi[0::2], hi[1::2])
        boxes.append((lo, hi))
    boxes.reverse()

    def near(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = boxes[level]
        gap = np.maximum(0, np.maximum(lo[a] - hi[b], lo[b] - hi[a]))
        gap[~np.isfinite(gap)] = np.inf
        return ((gap**2).sum(axis=1) <= radius * radius) & (owned[level][a] | owned[level][b])

    a = b = np.zeros(1, np.int64)
    stack = [(0, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            h = len(a) // 2
            stack += [(level, a[h:], b[h:]), (level, a[:h], b[:h])]
            continue
        if level < depth:
            x = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1])
            y = np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            ok = x <= y
            x, y = x[ok], y[ok]
            ok = near(level + 1, x, y)
            if ok.any():
                stack.append((level + 1, x[ok], y[ok]))
            continue
        p = pts.reshape(1 << depth, size, 3)
        with np.errstate(invalid="ignore"):
            d2 = ((p[a][:, :, None, :] - p[b][:, None, :, :]) ** 2).sum(axis=3)
            hit = d2 <= radius * radius
        same = a == b
        hit[same] &= np.triu(np.ones((size, size), bool), 1)
        k, i, j = np.nonzero(hit)
        o = order.reshape(1 << depth, size)
        i, j = o[a[k], i], o[b[k], j]
        if len(i):
            yield np.minimum(i, j), np.maximum(i, j)


def _assign(batches: Iterator[pa.RecordBatch], splits: Splits, margin: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lat, lon = (np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) for c in ("lat", "lon"))
        row, leaf, own = place(unit_vectors(lat, lon), splits, margin)
        part = b.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own), *part.columns], ["leaf", "own", *b.schema.names])


def _join_leaf(batches: Iterator[pd.DataFrame], metres: float) -> Iterator[pd.DataFrame]:
    """Pairs of distinct positions whose smaller position this leaf owns; the exact great circle test decides."""
    pdf = pd.concat(list(batches))
    lat, lon, own = pdf["lat"].to_numpy(), pdf["lon"].to_numpy(), pdf["own"].to_numpy()
    pos = pdf[["p_lat", "p_lon", "n"]].to_numpy()
    for i, j in kd_pairs(unit_vectors(lat, lon), chord(metres), own):
        swap = (pos[i, 0] > pos[j, 0]) | ((pos[i, 0] == pos[j, 0]) & (pos[i, 1] > pos[j, 1]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        ok = own[i] & (haversine_m(lat[i], lon[i], lat[j], lon[j]) <= metres)
        if ok.any():
            yield pd.DataFrame(np.concatenate([pos[i[ok]], pos[j[ok]]], axis=1), columns=PAIR)


PAIR = ["a_lat", "a_lon", "a_n", "b_lat", "b_lon", "b_n"]
VALID = "p_lat between -90000000000 and 90000000000 and p_lon between -180000000000 and 180000000000"


def near_positions(points: DataFrame, metres: float, sample: DataFrame | None = None, rows: int | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Pairs of positions ``a_lat, a_lon, a_n, b_lat, b_lon, b_n`` (nanodegrees, points there) within a distance.

    Each pair of two positions comes out once, the smaller one first, and each position of several points with itself: the points
    at a position are its members and need not be expanded. The k-d splits are fitted on a bounded sample of
    ``sample``; every position is then placed exactly, with copies in each leaf closer than the radius, whatever the sample
    looked like. Leaves hand on their pairs piece by piece; places denser than a leaf should be are split below the
    radius. Points with a null or impossible position are nobody's neighbour.
    """
    valid = points.filter(VALID)
    source = (sample if sample is not None else valid).select("p_lat", "p_lon").filter(VALID)
    n = rows if rows is not None else source.count()
    leaves = max(1, min(-(-n // leaf_rows), MOST_SAMPLED // 8))
    frac = min(1.0, max(SAMPLE_ROWS, 8 * leaves) / max(n, 1))
    seen = (source if frac >= 1 else source.sample(frac, 17)).toPandas().to_numpy(float)
    margin = chord(metres)
    splits = fit_splits(unit_vectors(seen[:, 0] * 1e-9, seen[:, 1] * 1e-9), leaves, margin, 4 * leaf_rows * frac)
    positions = valid.groupBy("p_lat", "p_lon").agg(F.count(F.lit(1)).alias("n"))
    degrees = positions.select("p_lat", "p_lon", "n", (F.lit(1e-9) * F.col("p_lat")).alias("lat"), (F.lit(1e-9) * F.col("p_lon")).alias("lon"))
    placed = degrees.mapInArrow(lambda it: _assign(it, splits, margin), "leaf bigint, own boolean, p_lat bigint, p_lon bigint, n bigint, lat double, lon double")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _join_leaf(batches, metres)

    near = placed.groupBy("leaf").applyInPandas(join, ", ".join(f"{c} bigint" for c in PAIR))
    twins = positions.filter("n > 1").select(*[F.col(c).alias(f"{side}_{c.removeprefix('p_')}") for side in "ab" for c in ("p_lat", "p_lon", "n")])
    return near.unionByName(twins)


def near_pairs(points: DataFrame, metres: float, sample: DataFrame | None = None, rows: int | None = None, leaf_rows: int = LEAF_ROWS, block: int = BLOCK) -> DataFrame:
    """All pairs ``id_a < id_b`` of points ``id bigint, p_lat bigint, p_lon bigint`` (nanodegrees) within a distance.

    The pairs of ``near_positions`` expanded to their points. A position that holds a third of all points costs the
    spatial join one row; its points are cut into blocks by a hash of the id, and pairs of blocks are expanded apart from each
    other. Repeated ids are taken as one point each row.
    """
    pairs = near_positions(points, metres, sample, rows, leaf_rows)
    valid = points.filter(VALID).select("id", "p_lat", "p_lon")
    total = rows if rows is not None else valid.count()
    crowd = max(block, total // MOST_CROWDED)
    blocks = lambda n: F.when(F.col(n) > crowd, F.ceil(F.col(n) / block)).otherwise(1).cast("int")
    crowded = valid.groupBy("p_lat", "p_lon").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("p_lat", "p_lon", blocks("n").alias("blocks"))
    cut = valid.join(F.broadcast(crowded), ["p_lat", "p_lon"], "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    side = lambda name, s: cut.select(F.col("id").alias(name), F.col("p_lat").alias(f"{s}_lat"), F.col("p_lon").alias(f"{s}_lon"), F.col("block").alias(f"{s}_block"))
    spread = pairs.withColumn("a_block", F.explode(F.sequence(F.lit(0), blocks("a_n") - 1))).withColumn("b_block", F.explode(F.sequence(F.lit(0), blocks("b_n") - 1)))
    both = spread.join(side("i", "a"), ["a_lat", "a_lon", "a_block"]).join(side("j", "b"), ["b_lat", "b_lon", "b_block"])
    same = (F.col("a_lat") == F.col("b_lat")) & (F.col("a_lon") == F.col("b_lon"))
    return both.filter(F.when(same, F.col("i") < F.col("j")).otherwise(F.col("i") != F.col("j"))).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
