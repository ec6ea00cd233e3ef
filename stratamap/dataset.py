"""A facade over one extract: its tables and workloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamap.operators import extract
from stratamap.session import cut, ship_package
from stratamap.sources import datasource, model

NODE = ["path", "blob_offset", "group_idx", "elem_idx", "kind", "is_dense", "id", "nano_lat", "nano_lon", "tags", "raw_tags", "info"]
WAY = ["path", "blob_offset", "group_idx", "elem_idx", "kind", "id", "tags", "raw_tags", "info", "refs", "raw_refs", "node_locations"]
RELATION = ["path", "blob_offset", "group_idx", "elem_idx", "kind", "id", "tags", "raw_tags", "info", "members"]


class Extract:
    """Tables of the extract at ``path`` (a file, folder, pattern or comma-separated list of them).

    Every table is a fresh scan with its own kinds and columns, so nothing is decoded that a query does not
    read, and no scan carries another query's pruning. ``persist()`` what is used often.
    """

    def __init__(self, spark: SparkSession, path: str, framing: str = "lenient", **options: str):
        ship_package(spark)
        datasource.register(spark)
        self.spark, self.path, self.options = spark, path, {"framing": framing, **options}
        self._zones: list | None = None
        self._index: list | None = None

    def _load(self, fmt: str, **options: str) -> DataFrame:
        return self.spark.read.format(fmt).options(**self.options, **options).load(self.path)

    def elements(self, columns: Sequence[str] | None = None, kinds: Sequence[str] = model.KINDS, offsets: Sequence[tuple[str, int]] | None = None) -> DataFrame:
        """All elements; only ``columns`` and ``kinds`` are decoded, only ``offsets`` visited."""
        o = {"columns": ",".join(columns or model.ELEMENTS), "kinds": ",".join(kinds)}
        if offsets is not None:
            o["offsets"] = ",".join(f"{p}@{b}" for p, b in offsets)
        return self._load("strata_elements", **o)

    def nodes(self, columns: Sequence[str] | None = None, **kw) -> DataFrame:
        return self.elements(columns or NODE, ("node",), **kw)

    def ways(self, columns: Sequence[str] | None = None, **kw) -> DataFrame:
        return self.elements(columns or WAY, ("way",), **kw)

    def relations(self, columns: Sequence[str] | None = None, **kw) -> DataFrame:
        return self.elements(columns or RELATION, ("relation",), **kw)

    def blobs(self) -> DataFrame:
        return self._load("strata_blobs")

    def index(self) -> list | None:
        """The blobs in file order, read from headers once and kept; None where there are more than ``extract.MAX_ZONES``."""
        if self._index is None:
            self._index = self.blobs().orderBy("path", "blob_offset").limit(extract.MAX_ZONES + 1).collect()
        return self._index if len(self._index) <= extract.MAX_ZONES else None

    def header(self) -> DataFrame:
        return self._load("strata_header")

    def string_tables(self) -> DataFrame:
        return self._load("strata_strings")

    def tags(self, kinds: Sequence[str] = model.KINDS) -> DataFrame:
        return extract.tag_rows(self.elements(["kind", "id", "tags"], kinds))

    def way_refs(self) -> DataFrame:
        return extract.way_refs(self.ways(["id", "refs"]))

    def relation_members(self) -> DataFrame:
        return extract.relation_members(self.relations(["id", "members"]))

    def blob_zones(self, kinds: Sequence[str] = model.KINDS) -> DataFrame:
        """Id ranges per blob and kind; only ids of the kinds are decoded."""
        return self._load("strata_zones", kinds=",".join(kinds))

    def node_zones(self) -> list | None:
        """Id ranges of the blobs with nodes, computed once and kept; None where there are too many to hold."""
        if self._zones is None:
            self._zones = extract.held_zones(self.blob_zones(("node",)))
        return self._zones if len(self._zones) <= extract.MAX_ZONES else None

    def count_by_kind(self) -> DataFrame:
        return extract.count_by_kind(self.elements(["kind"]))

    def map_reduce(self, fold: Callable, identity, reduce: Callable, columns: Sequence[str] | None = None):
        return extract.map_reduce(self.elements(columns), fold, identity, reduce)

    def for_each(self, visit: Callable, kinds: Sequence[str] = model.KINDS, columns: Sequence[str] | None = None) -> None:
        """Visit elements in file order; of ``columns`` those of the place are needed for the order."""
        extract.for_each(self.elements(columns, kinds), visit)

    def ways_and_deps(self, predicate: Column, pruned: bool = False, columns: Sequence[str] = ("kind", "id", "tags", "refs", "nano_lat", "nano_lon")) -> DataFrame:
        """Matching ways and the nodes they depend on.

        With ``pruned``, nodes are read only from blobs whose id range holds a wanted id; the ranges are
        computed once per extract and the wanted ids once per call. Rows are the same
        either way.
        """
        ways = self.elements(columns, ("way",))
        offsets = wanted = None
        if pruned:
            wanted = cut(extract.distinct_refs(self.elements(list(dict.fromkeys([*columns, "refs"])), ("way",)).filter(predicate)))
            zones = self.node_zones()
            offsets = None if zones is None else extract.zones_hit(zones, wanted)
        return extract.ways_and_deps(ways, self.elements(columns, ("node",), offsets=offsets), predicate, wanted)

    def header_has(self, feature: str) -> DataFrame:
        """Files that require the feature."""
        return self.header().filter(F.array_contains("required_features", feature)).select("path")

    def blobs_with(self, kind: str) -> DataFrame:
        """Blobs that hold at least one element of the kind, with its id range."""
        return self.blob_zones((kind,))
