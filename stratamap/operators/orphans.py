"""References to records that do not exist, over composite keys with partial nulls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def _mask_filter(cols: Sequence[str], mask: Sequence[bool]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(cols, mask)])


def _anti(part: DataFrame, targets: DataFrame, keys: Sequence[str], hot_rows: int, total: int) -> DataFrame:
    """Rows of ``part`` whose ``keys`` have no target; hot keys never meet in one task.

    Distinct keys are counted with a map-side combine and anti-joined, one row per key. Keys holding more
    than ``hot_rows`` rows are at most total/hot_rows many, so their list is broadcast within that bound
    and their rows are judged where they lie; all other rows are shuffled on the key, each key below the limit.
    """
    keys = list(keys)
    counted = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    goals = targets.select(*keys).dropna().distinct().withColumn("_hit", F.lit(True))
    judged = counted.join(goals, keys, "left").select(*keys, "_n", F.col("_hit").isNull().alias("_orphan"))
    missing = judged.filter("_orphan").select(*keys)
    if total <= hot_rows:
        return part.join(missing, keys, "left_semi")
    hot = judged.filter(F.col("_n") > hot_rows).select(*keys, F.col("_orphan").alias("_hot_orphan"))
    marked = part.join(F.broadcast(hot), keys, "left")
    at_once = marked.filter("_hot_orphan").drop("_hot_orphan")
    rest = marked.filter(F.col("_hot_orphan").isNull()).drop("_hot_orphan")
    return at_once.unionByName(rest.join(missing, keys, "left_semi"))


def orphan_references(refs: DataFrame, targets: DataFrame, keys: Sequence[str], match: str = "simple", hot_rows: int | None = None, total: int | None = None) -> DataFrame:
    """Rows of ``refs`` whose reference ``keys`` leads to no row of ``targets``.

    ``match`` declares what a partly null reference means, as in SQL foreign keys:

    * ``simple``: a reference with any null is satisfied;
    * ``partial``: the non-null columns must occur together in some target row;
    * ``full``: a reference that is null in some but not all columns is an orphan.

    A wholly null reference refers to nothing and is satisfied throughout. References are grouped by their
    null mask (2**k masks of k columns, a fixed number) and each mask is anti-joined on its non-null
    columns only. Repeated references all come out; an empty ``targets`` makes every judged reference an
    orphan, an empty ``refs`` gives an empty result. Target rows with a null in a compared column match nothing.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    keys = list(keys)
    total = refs.count() if total is None else total
    hot_rows = hot_rows or max(200_000, total // 1000)
    parts = []
    for mask in product((True, False), repeat=len(keys)):
        used = [k for k, m in zip(keys, mask) if m]
        if not used or (match == "simple" and len(used) < len(keys)):
            continue
        part = refs.filter(_mask_filter(keys, mask))
        parts.append(part if match == "full" and len(used) < len(keys) else _anti(part, targets, used, hot_rows, total))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, table: str, period: str) -> DataFrame:
    """Orphan references and distinct missing keys per table and period."""
    return orphans.groupBy(table, period).agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("missing_id").alias("n_missing"))


def element_references(way_refs: DataFrame, blob_zones: DataFrame) -> DataFrame:
    """All references to nodes as rows ``ref_table, owner_key, kind, node_id, month_key``.

    Way references and both bounds of each node id range. A null month stays null; null references stay, too.
    """
    ways = way_refs.select(
        F.lit("way_refs").alias("ref_table"), F.col("way_id").cast("string").alias("owner_key"), F.lit("node").alias("kind"),
        F.col("node_ref").alias("node_id"), F.date_format("added_at", "yyyy-MM").alias("month_key"),
    )
    zones = blob_zones.filter(F.col("kind") == "node").select(
        F.lit("blob_zones").alias("ref_table"), F.concat_ws("@", "file_path", F.col("blob_offset").cast("string")).alias("owner_key"), "kind",
        F.explode(F.array("min_id", "max_id")).alias("node_id"), F.date_format("indexed_at", "yyyy-MM").alias("month_key"),
    )
    return ways.unionByName(zones)
