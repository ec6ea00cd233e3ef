"""Spark data sources over block-structured extracts, and a sink for elements.

Formats: ``strata_blobs`` (headers only), ``strata_header``, ``strata_elements`` (read and write),
``strata_strings`` and ``strata_zones``. Pruning is by immutable options only, so a reader that Spark keeps between queries never
remembers a filter of another one:

* ``kinds``: comma-separated element kinds to decode;
* ``columns``: comma-separated columns to decode and return;
* ``offsets``: comma-separated blob offsets to visit, for a single file (``path@offset`` for several);
* ``framing``: ``lenient`` (default) or ``strict``; ``start_offset``: where the first blob begins;
* ``split_bytes``: body bytes that one partition should hold; ``range_bytes``: bytes of a file that one partition holds where
  blobs are found by the tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stratamap.sources import blocks, framing, model
from stratamap.sources.encode import Layout, blob, encode_blocks, header_message
from stratamap.sources.errors import ExtractError
from stratamap.sources.files import Folder, file_size, list_files, open_file

#: From so many files or bytes on, headers are not read for the plan: tasks find the blobs of their ranges of bytes.
SCAN_IN_TASKS, PLANNED_BYTES = 64, 16 << 30


@dataclass
class Split(InputPartition):
    """Blobs of one file, or a range of its bytes (to the end without ``high``) in which the task finds them."""

    files: tuple[str, ...]
    heads: tuple[framing.BlobHead, ...] | None = None
    low: int = 0
    high: int | None = None


def names_of(text: str | None, known: Sequence[str]) -> list[str]:
    names = [x.strip() for x in text.split(",") if x.strip()] if text else list(known)
    bad = set(names) - set(known)
    if bad:
        raise ValueError(f"unknown: {sorted(bad)}; known: {list(known)}")
    return names


class BlockReader(DataSourceReader):
    """Plans splits at blob borders by a header-only scan, and decodes the blobs of a split."""

    def __init__(self, options: dict[str, str], only_heads: bool = False):
        self.spec = options.get("path") or options.get("paths") or ""
        self.strict = options.get("framing", "lenient") == "strict"
        if options.get("framing", "lenient") not in framing.FRAMINGS:
            raise ValueError(f"framing must be one of {framing.FRAMINGS}")
        self.start = int(options.get("start_offset", 0))
        self.split_bytes = int(options.get("split_bytes", 8 << 20))
        self.range_bytes = int(options.get("range_bytes", 128 << 20))
        self.offsets: set[str] | None = {x.strip() for x in options["offsets"].split(",") if x.strip()} if options.get("offsets") is not None else None
        self.only_heads = only_heads

    def wanted(self, path: str, head: framing.BlobHead) -> bool:
        return self.offsets is None or str(head.offset) in self.offsets or f"{path}@{head.offset}" in self.offsets

    def heads(self, path: str) -> Iterator[framing.BlobHead]:
        if self.offsets is None:
            yield from framing.scan_heads(path, self.strict, self.start)
            return
        own = {x.rpartition("@") for x in self.offsets}
        with open_file(path) as f:
            for offset in sorted(int(o) for p, _, o in own if p in ("", path)):
                yield framing.head_at(f, offset, self.strict)

    def partitions(self) -> Sequence[InputPartition]:
        files = list_files(self.spec)
        if self.only_heads:
            return [Split((f,)) for f in files] or [Split(())]
        if len(files) >= SCAN_IN_TASKS or (len(files) and sum(map(file_size, files)) > PLANNED_BYTES):
            return self.ranges(files)
        out: list[Split] = []
        for f in files:
            held: list[framing.BlobHead] = []
            size = 0
            for head in self.heads(f):
                if held and size + head.datasize > self.split_bytes:
                    out.append(Split((f,), tuple(held)))
                    held, size = [], 0
                held.append(head)
                size += head.datasize
            if held:
                out.append(Split((f,), tuple(held)))
        return out or [Split(())]

    def ranges(self, files: Sequence[str]) -> list[Split]:
        """Ranges of bytes; a file whose blobs are named is one split, as those are looked up directly."""
        out = []
        for f in files:
            cuts = list(range(0, file_size(f), self.range_bytes)) or [0] if self.offsets is None else [0]
            out += [Split((f,), None, low, high) for low, high in zip(cuts, [*cuts[1:], None])]
        return out

    def found(self, path: str, split: Split) -> Iterator[framing.BlobHead]:
        if split.heads is not None:
            return iter(split.heads)
        return self.heads(path) if self.offsets is not None else framing.range_heads(path, self.strict, split.low, split.high, self.start)

    def each(self, split: Split) -> Iterator[tuple[str, framing.BlobHead, bytes]]:
        for path in split.files:
            with open_file(path) as f:
                for head in self.found(path, split):
                    if self.wanted(path, head):
                        yield path, head, framing.read_body(f, head, self.strict)


class ElementReader(BlockReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.kinds = set(names_of(options.get("kinds"), model.KINDS))
        self.columns = names_of(options.get("columns"), list(model.ELEMENTS))

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        for path, head, body in self.each(split):
            if head.blob_type != framing.DATA_TYPE:
                if not self.strict:
                    framing.parse_body(body)
                continue
            yield from blocks.decode_block(framing.payload(body), path, head.offset, self.columns, self.kinds)


class ZoneReader(BlockReader):
    """Id ranges by blob and kind; of the elements nothing but ids is decoded, and one row a blob and kind leaves the task."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.kinds = set(names_of(options.get("kinds"), model.KINDS))

    def read(self, split: Split) -> Iterator[tuple]:
        for path, head, body in self.each(split):
            if head.blob_type != framing.DATA_TYPE:
                continue
            zones: dict[str, tuple[int, int, int]] = {}
            for b in blocks.decode_block(framing.payload(body), path, head.offset, ["kind", "id"], self.kinds):
                ids, kind = b.column("id").to_numpy(), b.column("kind")[0].as_py()
                low, high, n = zones.get(kind, (ids[0], ids[0], 0))
                zones[kind] = (min(low, ids.min()), max(high, ids.max()), n + len(ids))
            for kind, (low, high, n) in zones.items():
                yield path, head.offset, kind, int(low), int(high), n


class BlobListReader(BlockReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options, only_heads=True)

    def read(self, split: Split) -> Iterator[tuple]:
        for path in split.files:
            for seq, h in enumerate(self.heads(path)):
                yield path, seq, h.offset, h.blob_type, h.header_size, h.datasize


class HeaderReader(BlockReader):
    def read(self, split: Split) -> Iterator[tuple]:
        for path, head, body in self.each(split):
            if head.blob_type == framing.HEADER_TYPE or (self.offsets is not None and self.must(head)):
                h = blocks.decode_header(framing.payload(body))
                yield (path, head.offset, *[(None if h["bbox"] is None else tuple(h["bbox"].values())) if c == "bbox" else h[c] for c in list(model.HEADER)[2:]])

    @staticmethod
    def must(head: framing.BlobHead) -> bool:
        raise ExtractError(f"the blob at {head.offset} is of type {head.blob_type}, not {framing.HEADER_TYPE}")


class StringReader(BlockReader):
    def read(self, split: Split) -> Iterator[tuple]:
        for path, head, body in self.each(split):
            if head.blob_type == framing.DATA_TYPE:
                yield path, head.offset, [bytearray(b) for b in blocks.string_table(framing.payload(body))]
            elif self.offsets is not None:
                raise ExtractError(f"the blob at {head.offset} is of type {head.blob_type}, not {framing.DATA_TYPE}")


class _Source(DataSource):
    FORMAT, COLUMNS, READER = "", {}, BlockReader

    @classmethod
    def name(cls) -> str:
        return cls.FORMAT

    def schema(self) -> str:
        return model.ddl(self.COLUMNS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.READER(dict(self.options))


class BlobSource(_Source):
    """One row per blob, from headers alone."""

    FORMAT, COLUMNS, READER = "strata_blobs", model.BLOBS, BlobListReader


class HeaderSource(_Source):
    """One row per header block."""

    FORMAT, COLUMNS, READER = "strata_header", model.HEADER, HeaderReader


class StringSource(_Source):
    """One row per data block with its string table."""

    FORMAT, COLUMNS, READER = "strata_strings", model.STRINGS, StringReader


class ZoneSource(_Source):
    """One row per data block and kind in it, with the range of its ids."""

    FORMAT, COLUMNS, READER = "strata_zones", model.ZONES, ZoneReader


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ElementWriter(DataSourceArrowWriter):
    """Each task writes one extract of its own; names appear only when the whole job has succeeded."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        number = lambda k: int(options[k]) if options.get(k) is not None else None
        self.path = options["path"]
        self.layout = Layout(options.get("compression", "zlib"), int(options.get("block_size", 8000)), number("granularity"), number("lat_offset"), number("lon_offset"), number("date_granularity"))
        self.required = tuple(x for x in options.get("required_features", "OsmSchema-V0.6,DenseNodes").split(",") if x)
        self.optional = tuple(x for x in options.get("optional_features", "").split(",") if x)
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, name, n = Folder(self.path), f".part-{uuid.uuid4().hex}.pbf", 0

        def rows() -> Iterator[dict]:
            nonlocal n
            for b in batches:
                n += b.num_rows
                yield from b.to_pylist()

        with folder.create(name) as f:
            f.write(blob(framing.HEADER_TYPE, header_message(self.required, self.optional), self.layout.compression))
            for data in encode_blocks(rows(), self.layout):
                f.write(data)
        if n:
            return Written(name)
        folder.delete(name)
        return Written(None)

    def commit(self, messages: list[Written | None]) -> None:
        folder, new = Folder(self.path), [m.name for m in messages if m is not None and m.name]
        if self.overwrite:
            for name in folder.names():
                if name not in new and name.startswith(("part-", ".part-")):
                    folder.delete(name)
        for name in new:
            folder.rename(name, name[1:])
        folder.create("_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        written = {m.name for m in messages if m is not None and m.name}
        for name in folder.names():
            if name in written:
                folder.delete(name)


class ElementSource(_Source):
    """Elements of an extract; also a sink."""

    FORMAT, COLUMNS, READER = "strata_elements", model.ELEMENTS, ElementReader

    def schema(self) -> str:
        return model.ddl({c: model.ELEMENTS[c] for c in names_of(self.options.get("columns"), list(model.ELEMENTS))})

    def writer(self, schema: StructType, overwrite: bool) -> ElementWriter:
        return ElementWriter(dict(self.options), overwrite)


SOURCES = (BlobSource, HeaderSource, ElementSource, StringSource, ZoneSource)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for s in SOURCES:
        spark.dataSource.register(s)


__all__ = ["SOURCES", "list_files", "register"]
