"""Writing extracts: rows of elements to framed blobs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from stratamap.sources.framing import DATA_TYPE, HEADER_TYPE
from stratamap.sources.wire import put_bytes, put_number, put_packed, zigzag


@dataclass(frozen=True)
class Layout:
    """How blocks are laid out; scales left at None are not written and mean the format's defaults."""

    compression: str = "zlib"
    block_size: int = 8000
    granularity: int | None = None
    lat_offset: int | None = None
    lon_offset: int | None = None
    date_granularity: int | None = None

    @property
    def step(self) -> int:
        return 100 if self.granularity is None else self.granularity

    @property
    def date_step(self) -> int:
        return 1000 if self.date_granularity is None else self.date_granularity

    def raw_lat(self, nano: int) -> int:
        return exact(nano - (self.lat_offset or 0), self.step)

    def raw_lon(self, nano: int) -> int:
        return exact(nano - (self.lon_offset or 0), self.step)


def exact(n: int, step: int) -> int:
    q, r = divmod(n, step)
    if r:
        raise ValueError(f"{n} is no multiple of {step}: choose another granularity or offset")
    return q


def frame(kind: str, body: bytes) -> bytes:
    head = put_bytes(1, kind.encode()) + put_number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def blob(kind: str, message: bytes, compression: str = "zlib") -> bytes:
    """A framed blob with a raw or zlib payload."""
    if compression == "raw":
        return frame(kind, put_bytes(1, message))
    if compression != "zlib":
        raise ValueError(f"compression must be raw or zlib, not {compression}")
    return frame(kind, put_number(2, len(message)) + put_bytes(3, zlib.compress(message)))


def header_message(required: Sequence[str] = ("OsmSchema-V0.6", "DenseNodes"), optional: Sequence[str] = (), program: str | None = "stratamap", source: str | None = None, bbox: tuple[int, int, int, int] | None = None, replication: tuple[int | None, int | None, str | None] = (None, None, None)) -> bytes:
    out = b""
    if bbox:
        out += put_bytes(1, b"".join(put_number(i, zigzag(v)) for i, v in enumerate(bbox, 1)))
    out += b"".join(put_bytes(4, f.encode()) for f in required) + b"".join(put_bytes(5, f.encode()) for f in optional)
    for field, text in ((16, program), (17, source)):
        if text is not None:
            out += put_bytes(field, text.encode())
    for field, number in ((32, replication[0]), (33, replication[1])):
        if number is not None:
            out += put_number(field, number)
    return out + (put_bytes(34, replication[2].encode()) if replication[2] is not None else b"")


def deltas(values: Sequence[int]) -> np.ndarray:
    return np.diff(np.asarray(values, np.int64), prepend=0) if len(values) else np.empty(0, np.int64)


class BlockBuilder:
    """Collects elements of any kind and gives one block message; one group per kind and form, in order of arrival."""

    MEMBER = {"node": 0, "way": 1, "relation": 2}

    def __init__(self, layout: Layout):
        self.layout = layout
        self.index: dict[bytes, int] = {b"": 0}
        self.groups: dict[str, list[dict]] = {}
        self.n = 0

    def sid(self, text: str | bytes | None) -> int:
        b = text if isinstance(text, bytes) else (text or "").encode()
        return self.index.setdefault(b, len(self.index))

    def add(self, row: dict) -> None:
        form = "dense" if row["kind"] == "node" and row.get("is_dense") else row["kind"]
        self.groups.setdefault(form, []).append(row)
        self.n += 1

    def info_fields(self, info: dict | None) -> bytes:
        if info is None:
            return b""
        out = b""
        if info.get("version") is not None:
            out += put_number(1, info["version"])
        if info.get("timestamp_ms") is not None:
            out += put_number(2, exact(info["timestamp_ms"], self.layout.date_step))
        for field, name in ((3, "changeset"), (4, "uid")):
            if info.get(name) is not None:
                out += put_number(field, info[name])
        if info.get("user") is not None:
            out += put_number(5, self.sid(info["user"]))
        if info.get("visible") is False:
            out += put_number(6, 0)
        return put_bytes(4, out)

    def tag_fields(self, tags: Iterable[dict] | None) -> bytes:
        pairs = [(self.sid(t["key"]), self.sid(t["value"])) for t in tags or ()]
        return put_packed(2, [k for k, _ in pairs]) + put_packed(3, [v for _, v in pairs])

    def dense(self, rows: list[dict]) -> bytes:
        lay = self.layout
        out = put_packed(1, deltas([r["id"] for r in rows]), True)
        infos = [r.get("info") for r in rows]
        if any(i is not None for i in infos):
            if any(i is None for i in infos):
                raise ValueError("dense nodes of one block all have info or all have none")
            part = put_packed(1, [i["version"] if i["version"] is not None else -1 for i in infos])
            for field, col in ((2, [exact(i["timestamp_ms"] or 0, lay.date_step) for i in infos]), (3, [i["changeset"] or 0 for i in infos]), (4, [i["uid"] or 0 for i in infos]), (5, [self.sid(i["user"]) for i in infos])):
                part += put_packed(field, deltas(col), True)
            if any(i.get("visible") is False for i in infos):
                part += put_packed(6, [0 if i.get("visible") is False else 1 for i in infos])
            out += put_bytes(5, part)
        out += put_packed(8, deltas([lay.raw_lat(r["nano_lat"]) for r in rows]), True) + put_packed(9, deltas([lay.raw_lon(r["nano_lon"]) for r in rows]), True)
        kv: list[int] = []
        for r in rows:
            for t in r.get("tags") or ():
                kv += [self.sid(t["key"]), self.sid(t["value"])]
            kv.append(0)
        return put_bytes(2, out + (put_packed(10, kv) if len(kv) > len(rows) else b""))

    def node(self, r: dict) -> bytes:
        body = put_number(1, zigzag(r["id"])) + self.tag_fields(r.get("tags")) + self.info_fields(r.get("info"))
        return put_bytes(1, body + put_number(8, zigzag(self.layout.raw_lat(r["nano_lat"]))) + put_number(9, zigzag(self.layout.raw_lon(r["nano_lon"]))))

    def way(self, r: dict) -> bytes:
        body = put_number(1, r["id"]) + self.tag_fields(r.get("tags")) + self.info_fields(r.get("info")) + put_packed(8, deltas(r.get("refs") or ()), True)
        places = r.get("node_locations") or ()
        body += put_packed(9, deltas([self.layout.raw_lat(p["nano_lat"]) for p in places]), True) + put_packed(10, deltas([self.layout.raw_lon(p["nano_lon"]) for p in places]), True)
        return put_bytes(3, body)

    def relation(self, r: dict) -> bytes:
        members = r.get("members") or ()
        body = put_number(1, r["id"]) + self.tag_fields(r.get("tags")) + self.info_fields(r.get("info"))
        body += put_packed(8, [self.sid(m["role"]) for m in members]) + put_packed(9, deltas([m["member_id"] for m in members]), True) + put_packed(10, [self.MEMBER[m["member_type"]] for m in members])
        return put_bytes(4, body)

    def message(self) -> bytes:
        groups = []
        for form, rows in self.groups.items():
            groups.append(put_bytes(2, self.dense(rows) if form == "dense" else b"".join(getattr(self, form)(r) for r in rows)))
        lay = self.layout
        scales = b"".join(put_number(f, v) for f, v in ((17, lay.granularity), (18, lay.date_granularity), (19, lay.lat_offset), (20, lay.lon_offset)) if v is not None)
        return put_bytes(1, b"".join(put_bytes(1, s) for s in self.index)) + b"".join(groups) + scales


def encode_blocks(rows: Iterable[dict], layout: Layout) -> Iterable[bytes]:
    """Framed data blobs of at most ``block_size`` elements each; a block holds elements of one form."""
    builder, form = BlockBuilder(layout), None
    for r in rows:
        now = (r["kind"], bool(r.get("is_dense")), r.get("info") is None)
        if builder.n and (builder.n >= layout.block_size or now != form):
            yield blob(DATA_TYPE, builder.message(), layout.compression)
            builder = BlockBuilder(layout)
        form = now
        builder.add(r)
    if builder.n:
        yield blob(DATA_TYPE, builder.message(), layout.compression)


def encode_file(rows: Iterable[dict], layout: Layout = Layout(), **header) -> bytes:
    """A whole extract in memory, for small inputs."""
    return blob(HEADER_TYPE, header_message(**header), layout.compression) + b"".join(encode_blocks(rows, layout))
