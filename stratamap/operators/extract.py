"""Operators on decoded extracts: counts, map/reduce, visits, zone maps and ways with their nodes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")

#: Zones up to which pruning by id ranges is tried; more would not fit the driver's list of offsets.
MAX_ZONES = 1_000_000
#: Blobs that may be named in a scan's options; where more are hit, pruning gains little anyway.
MAX_OFFSETS = 100_000


def count_by_kind(elements: DataFrame) -> DataFrame:
    """Elements per kind; dense and plain nodes count together."""
    return elements.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def count_row(elements: DataFrame) -> DataFrame:
    """One row ``nodes, ways, relations``, zeros for an empty input."""
    return elements.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("node", "way", "relation")])


def map_reduce(elements: DataFrame, fold: Callable[[pa.RecordBatch], T], identity: T, reduce: Callable[[T, T], T]) -> T:
    """Fold Arrow batches of elements in each task, then merge the partial results in a tree on the executors.

    ``reduce`` must be associative and commutative and ``identity`` neutral: it may be merged in any number of
    times. Any failing block fails the whole call. An empty input gives ``identity``.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = identity
        for b in batches:
            held = reduce(held, fold(b))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["partial"])

    parts = elements.mapInArrow(partial, "partial binary").rdd.map(lambda r: pickle.loads(bytes(r.partial)))
    return parts.treeAggregate(identity, reduce, reduce)


ORDER = ["path", "blob_offset", "group_idx", "elem_idx"]


def for_each(elements: DataFrame, visit: Callable[[Any], None]) -> None:
    """Visit all elements on the driver in file order, one partition in memory at a time."""
    for row in elements.orderBy(*ORDER).toLocalIterator(prefetchPartitions=True):
        visit(row)


def blob_zones(elements: DataFrame) -> DataFrame:
    """Smallest and largest id and row count per blob and kind; a blob without a kind has no row of it."""
    return elements.groupBy("path", "blob_offset", "kind").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))


def distinct_refs(ways: DataFrame) -> DataFrame:
    """The distinct node ids that ways refer to."""
    return ways.select(F.explode("refs").alias("id")).distinct()


def way_refs(ways: DataFrame) -> DataFrame:
    """One row per reference, ``way_id, pos, node_ref``; order and repeats are kept."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_ref"))


def relation_members(relations: DataFrame) -> DataFrame:
    """One row per member in order."""
    return relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).select("relation_id", "pos", "m.*")


def tag_rows(elements: DataFrame) -> DataFrame:
    """One row per tag: ``kind, id, pos, key, value``."""
    return elements.select("kind", "id", F.posexplode("tags").alias("pos", "t")).select("kind", "id", "pos", "t.key", "t.value")


def ways_and_deps(ways: DataFrame, nodes: DataFrame, predicate: Column, wanted: DataFrame | None = None) -> DataFrame:
    """The ways that match, and every stored version of each node they refer to; never relations.

    A left semi-join on distinct ids: Spark broadcasts the ids where its size estimate allows and shuffles
    both sides else. Ids are unique only within a kind, so only nodes are joined. References to missing nodes
    are skipped; a node comes out once per stored row, however many ways use it. ``wanted`` are the ids where they are
    known already.
    """
    hit = ways.filter(predicate)
    return hit.unionByName(nodes.join(distinct_refs(hit) if wanted is None else wanted, "id", "left_semi").select(*hit.columns))


def held_zones(zones: DataFrame, limit: int = MAX_ZONES) -> list:
    """The node zones ``path, blob_offset, min_id, max_id`` as rows, one more than ``limit`` at most."""
    return zones.filter("kind = 'node' and min_id is not null").select("path", "blob_offset", "min_id", "max_id").limit(limit + 1).collect()


def zones_hit(rows: list, ids: DataFrame) -> list[tuple[str, int]] | None:
    """Blobs whose node id range holds any of ``ids``; None where too many are hit to name.

    The sorted ranges are sent to the tasks (at most ``MAX_ZONES`` of them); each task finds the ranges its ids fall
    in by binary search. Ranges may overlap.
    """
    rows = list(rows)
    rows.sort(key=lambda r: r.min_id)
    if not rows:
        return []
    shared = ids.sparkSession.sparkContext.broadcast((np.array([r.min_id for r in rows]), np.array([r.max_id for r in rows])))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        hit = np.zeros(len(low), bool)
        for b in batches:
            x = np.unique(b.column(0).drop_null().to_numpy())
            if not len(x):
                continue
            # a zone is hit if some id is >= its low and <= its high
            at = np.searchsorted(x, low)
            ok = at < len(x)
            hit[ok] |= x[at[ok]] <= high[ok]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit))], ["zone"])

    found = ids.mapInArrow(find, "zone bigint").distinct().limit(MAX_OFFSETS + 1).collect()
    if len(found) > MAX_OFFSETS:
        return None
    return sorted((rows[r.zone].path, rows[r.zone].blob_offset) for r in found)
