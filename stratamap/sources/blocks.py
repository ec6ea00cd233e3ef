"""From the bytes of a block to Arrow columns, decoding only the columns and kinds that are asked for."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from stratamap.sources import model, wire
from stratamap.sources.errors import BadMessage
from stratamap.sources.wire import BYTES, VARINT, fields

#: Member types by number, and defaults of a block.
MEMBER_TYPES = ("node", "way", "relation")
GRANULARITY, DATE_GRANULARITY = 100, 1000


class Strings:
    """A block's string table. Texts are None where bytes are not UTF-8; index errors are found per use."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self._texts: list[str | None] | None = None

    @property
    def texts(self) -> list[str | None]:
        if self._texts is None:
            self._texts = [self._text(b) for b in self.raw]
        return self._texts

    @staticmethod
    def _text(b: bytes) -> str | None:
        try:
            return b.decode()
        except UnicodeDecodeError:
            return None

    def valid(self, ids: np.ndarray) -> np.ndarray:
        good = np.array([t is not None for t in self.texts], bool)
        inside = (ids >= 0) & (ids < len(good))
        return inside & np.append(good, False)[np.where(inside, ids, len(good))]

    def take(self, ids: np.ndarray, valid: np.ndarray) -> pa.Array:
        table = pa.array(self.texts or [None], pa.string())
        return table.take(pa.array(np.where(valid, ids, 0), mask=~valid))

    def errors(self, ids: np.ndarray, valid: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        """Why an id gives no text, null where it does or where ``mask`` is set."""
        bad = ~valid if mask is None else ~valid & ~mask
        out = np.full(len(ids), None, object)
        for i in np.flatnonzero(bad):
            out[i] = f"{'StringNotUtf8' if 0 <= ids[i] < len(self.raw) else 'StringIndexOutOfBounds'}: {ids[i]}"
        return pa.array(out, pa.string())


class Block:
    """A parsed primitive block: string table, scales and the byte ranges of its groups."""

    def __init__(self, data: bytes):
        self.data = data
        self.granularity, self.lat_offset, self.lon_offset, self.date_granularity = GRANULARITY, 0, 0, DATE_GRANULARITY
        table = None
        self.groups: list[tuple[int, int]] = []
        for number, kind, a, b in fields(data, where="block"):
            if number == 1 and kind == BYTES:
                table = [*(table or []), *(data[x:y] for n, k, x, y in fields(data, a, b, "string table") if n == 1 and k == BYTES)]
            elif number == 2 and kind == BYTES:
                self.groups.append((a, b))
            elif number == 17 and kind == VARINT:
                self.granularity = wire.int32(a)
            elif number == 18 and kind == VARINT:
                self.date_granularity = wire.int32(a)
            elif number == 19 and kind == VARINT:
                self.lat_offset = wire.signed(a)
            elif number == 20 and kind == VARINT:
                self.lon_offset = wire.signed(a)
        if table is None:
            raise BadMessage("block", "the string table is missing")
        self.strings = Strings(table)


def scaled(offset: int, step: int, raw: np.ndarray, where: str) -> np.ndarray:
    if len(raw) and abs(offset) + abs(step) * float(np.abs(raw.astype(float)).max()) > 9.2e18:
        raise BadMessage(where, "a scaled number leaves the 64-bit range")
    return offset + step * raw


def lists(flat: pa.Array, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat)


def within(size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Mask over flat lists of ``size``: the first ``limit`` entries of each."""
    start = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(start, size) < np.repeat(limit, size)


def tag_columns(keys: np.ndarray, vals: np.ndarray, size: np.ndarray, strings: Strings, want: set[str]) -> dict[str, pa.Array]:
    """``tags`` end before the first pair that gives no two texts; ``raw_tags`` hold every pair."""
    out = {}
    if "raw_tags" in want:
        out["raw_tags"] = lists(pa.StructArray.from_arrays([pa.array(keys), pa.array(vals)], fields=list(model.P_RAW)), size)
    if "tags" in want:
        ok = strings.valid(keys) & strings.valid(vals)
        keep = size
        if not ok.all():
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            keep = size.copy()
            np.minimum.at(keep, owner[~ok], place[~ok])
            mask = within(size, keep)
            keys, vals = keys[mask], vals[mask]
        every = np.ones(len(keys), bool)
        out["tags"] = lists(pa.StructArray.from_arrays([strings.take(keys, every), strings.take(vals, every)], fields=list(model.P_TAG)), keep)
    return out


def info_column(n: int, strings: Strings, version, ms, changeset, uid, sid, visible, unset: dict[str, np.ndarray], null: np.ndarray | None = None) -> pa.Array:
    """The info struct; ``unset`` masks single fields, ``null`` whole structs."""
    ok = strings.valid(sid)
    no_user = unset.get("sid", np.zeros(n, bool))
    parts = [
        pa.array(version, pa.int32(), mask=unset.get("version")), pa.array(ms, pa.int64(), mask=unset.get("ms")), pa.array(changeset, pa.int64(), mask=unset.get("changeset")),
        pa.array(uid, pa.int32(), mask=unset.get("uid")), strings.take(sid, ok & ~no_user), strings.errors(sid, ok, no_user), pa.array(visible, pa.bool_()),
    ]
    return pa.StructArray.from_arrays(parts, fields=list(model.P_INFO), mask=None if null is None else pa.array(null))


def split_dense_tags(kv: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and pairs per node of alternating ids; a 0 where a key should stand ends a node."""
    zero = np.flatnonzero(kv == 0)
    starts = np.append(0, zero + 1)
    size = np.append(zero, len(kv)) - starts
    if (size[:-1] % 2 == 0).all():
        starts, size = starts[:n], size[:n]
    else:  # some value id is 0: walk the key places
        s, e, i = [], [], 0
        at = kv.tolist()
        while i < len(at) and len(s) < n:
            s.append(i)
            while i < len(at) and at[i] != 0:
                i += 2
            e.append(min(i, len(at)))
            i += 1
        starts, size = np.array(s, np.int64), np.array(e, np.int64) - np.array(s, np.int64)
    pairs = np.zeros(n, np.int64)
    pairs[: len(size)] = size // 2
    at = np.repeat(np.append(starts, np.zeros(max(0, n - len(starts)), np.int64))[:n] - 2 * (np.cumsum(pairs) - pairs), pairs) + 2 * np.arange(int(pairs.sum()))
    return kv[at], kv[at + 1], pairs


def dense_nodes(block: Block, a: int, b: int, want: set[str]) -> dict[str, pa.Array]:
    data = block.data
    parts: dict[int, list[bytes]] = {1: [], 8: [], 9: [], 10: []}
    info: dict[int, list[bytes]] | None = None
    for number, kind, x, y in fields(data, a, b, "dense nodes"):
        if number in parts:
            parts[number].append(data[x:y] if kind == BYTES else wire.put_varint(x))
        elif number == 5 and kind == BYTES:
            info = info or {k: [] for k in range(1, 7)}
            for n, k, p, q in fields(data, x, y, "dense info"):
                if n in info:
                    info[n].append(data[p:q] if k == BYTES else wire.put_varint(p))
    get = lambda f: wire.varints(b"".join(parts[f]), "dense nodes")
    ids, lat, lon = (wire.zigzag_decoded(get(f)) for f in (1, 8, 9))
    n = min(len(ids), len(lat), len(lon))
    out: dict[str, pa.Array] = {"id": pa.array(wire.running(ids[:n], "dense ids"))}
    if "nano_lat" in want:
        out["nano_lat"] = pa.array(scaled(block.lat_offset, block.granularity, wire.running(lat[:n], "dense lat"), "dense lat"))
    if "nano_lon" in want:
        out["nano_lon"] = pa.array(scaled(block.lon_offset, block.granularity, wire.running(lon[:n], "dense lon"), "dense lon"))
    if {"tags", "raw_tags"} & want:
        k, v, size = split_dense_tags(wire.as_int32(get(10)), n)
        out |= tag_columns(k, v, size, block.strings, want)
    if "info" in want:
        if info is None:
            out["info"] = pa.nulls(n, model.P_INFO)
        else:
            num = {f: wire.varints(b"".join(info[f]), "dense info") for f in info}
            m = min(n, *(len(num[f]) for f in range(1, 6)))
            fill = lambda v: np.append(v[:m], np.zeros(n - m, np.int64)).astype(np.int64)
            run = lambda f: fill(wire.running(wire.zigzag_decoded(num[f])[:m], "dense info"))
            seen = np.ones(n, bool)
            shown = num[6][:n] != 0
            seen[: len(shown)] = shown
            uid, sid = run(4), run(5)
            ms = scaled(0, block.date_granularity, run(2), "dense timestamp")
            null = np.arange(n) >= m
            out["info"] = info_column(n, block.strings, wire_int32(fill(wire.as_int32(num[1]))), ms, run(3), wire_int32(uid), sid, seen, {"sid": null}, null)
    return out


def wire_int32(v: np.ndarray) -> np.ndarray:
    if len(v) and (v.max() > 0x7FFFFFFF or v.min() < -0x80000000):
        raise BadMessage("info", "a number leaves the 32-bit range")
    return v


class Rows:
    """Row-coded elements of one kind: scalar fields per row, and spans of packed fields decoded all at once."""

    def __init__(self, data: bytes, packed: Sequence[int], zig_id: bool):
        self.data, self.zig_id = data, zig_id
        self.ids: list[int] = []
        self.spans: dict[int, list[tuple[int, bytes]]] = {f: [] for f in packed}
        self.lat: list[int] = []
        self.lon: list[int] = []
        self.info: list[tuple] = []

    def add(self, a: int, b: int, kind_name: str, scalar_position: bool, want_info: bool) -> None:
        data, row = self.data, len(self.ids)
        ident = lat = lon = None
        info = (None,) * 6
        for number, kind, x, y in fields(data, a, b, kind_name):
            if number == 1 and kind == VARINT:
                ident = wire.unzigzag(x) if self.zig_id else wire.signed(x)
            elif scalar_position and number == 8 and kind == VARINT:
                lat = wire.unzigzag(x)
            elif scalar_position and number == 9 and kind == VARINT:
                lon = wire.unzigzag(x)
            elif number == 4 and kind == BYTES:
                if want_info:
                    info = self.read_info(x, y)
            elif number in self.spans:
                self.spans[number].append((row, data[x:y] if kind == BYTES else wire.put_varint(x)))
        if ident is None or (scalar_position and (lat is None or lon is None)):
            raise BadMessage(kind_name, "a required field is missing")
        self.ids.append(ident)
        if scalar_position:
            self.lat.append(lat)
            self.lon.append(lon)
        self.info.append(info)

    def read_info(self, a: int, b: int) -> tuple:
        v: list = [None] * 6
        for number, kind, x, _ in fields(self.data, a, b, "info"):
            if kind == VARINT and 1 <= number <= 6:
                v[number - 1] = wire.int32(x) if number in (1, 4) else wire.signed(x) if number in (2, 3) else x & 0xFFFFFFFF if number == 5 else bool(x)
        return tuple(v)

    def packed(self, field: int) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of a packed field and how many each row has."""
        parts = self.spans[field]
        size = np.zeros(len(self.ids), np.int64)
        if not parts:
            return np.empty(0, np.uint64), size
        buf = b"".join(p for _, p in parts)
        flat = wire.varints(buf, "packed field")
        length = np.array([len(p) for _, p in parts])
        ends = np.append(0, np.cumsum(np.frombuffer(buf, np.uint8) < 128))
        stop = np.cumsum(length)
        np.add.at(size, [r for r, _ in parts], ends[stop] - ends[stop - length])
        return flat, size

    def tags(self, strings: Strings, want: set[str]) -> dict[str, pa.Array]:
        if not {"tags", "raw_tags"} & want:
            return {}
        (k, kn), (v, vn) = self.packed(2), self.packed(3)
        n = np.minimum(kn, vn)
        u32 = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return tag_columns(u32(k[within(kn, n)]), u32(v[within(vn, n)]), n, strings, want)

    def info_array(self, block: Block) -> pa.Array:
        n = len(self.ids)
        cols = list(zip(*self.info)) if n else [()] * 6
        raw = [np.array([0 if x is None else x for x in c], np.int64) for c in cols]
        unset = [np.array([x is None for x in c], bool) for c in cols]
        ms = scaled(0, block.date_granularity, raw[1], "timestamp")
        seen = np.array([True if x is None else x for x in cols[5]], bool)
        return info_column(n, block.strings, raw[0], ms, raw[2], raw[3], raw[4], seen, {"version": unset[0], "ms": unset[1], "changeset": unset[2], "uid": unset[3], "sid": unset[4]})


def plain_nodes(block: Block, spans: list[tuple[int, int]], want: set[str]) -> dict[str, pa.Array]:
    rows = Rows(block.data, (2, 3), True)
    for a, b in spans:
        rows.add(a, b, "node", True, "info" in want)
    out = {"id": pa.array(rows.ids, pa.int64()), **rows.tags(block.strings, want)}
    out["nano_lat"] = pa.array(scaled(block.lat_offset, block.granularity, np.array(rows.lat, np.int64), "lat"))
    out["nano_lon"] = pa.array(scaled(block.lon_offset, block.granularity, np.array(rows.lon, np.int64), "lon"))
    if "info" in want:
        out["info"] = rows.info_array(block)
    return out


def ways(block: Block, spans: list[tuple[int, int]], want: set[str]) -> dict[str, pa.Array]:
    rows = Rows(block.data, (2, 3, 8, 9, 10), False)
    for a, b in spans:
        rows.add(a, b, "way", False, "info" in want)
    out = {"id": pa.array(rows.ids, pa.int64()), **rows.tags(block.strings, want)}
    if "info" in want:
        out["info"] = rows.info_array(block)
    if {"refs", "raw_refs"} & want:
        flat, n = rows.packed(8)
        raw = wire.zigzag_decoded(flat)
        if "raw_refs" in want:
            out["raw_refs"] = lists(pa.array(raw), n)
        if "refs" in want:
            out["refs"] = lists(pa.array(wire.running_by(raw, n, "refs")), n)
    if "node_locations" in want:
        (la, ln), (lo, on) = rows.packed(9), rows.packed(10)
        n = np.minimum(ln, on)
        lat = wire.running_by(wire.zigzag_decoded(la), ln, "way lat")[within(ln, n)]
        lon = wire.running_by(wire.zigzag_decoded(lo), on, "way lon")[within(on, n)]
        pair = [pa.array(scaled(block.lat_offset, block.granularity, lat, "way lat")), pa.array(scaled(block.lon_offset, block.granularity, lon, "way lon"))]
        out["node_locations"] = lists(pa.StructArray.from_arrays(pair, fields=list(model.P_LOC)), n)
    return out


def relations(block: Block, spans: list[tuple[int, int]], want: set[str]) -> dict[str, pa.Array]:
    rows = Rows(block.data, (2, 3, 8, 9, 10), False)
    for a, b in spans:
        rows.add(a, b, "relation", False, "info" in want)
    out = {"id": pa.array(rows.ids, pa.int64()), **rows.tags(block.strings, want)}
    if "info" in want:
        out["info"] = rows.info_array(block)
    if "members" in want:
        (role, rn), (ref, mn), (kind, tn) = rows.packed(8), rows.packed(9), rows.packed(10)
        n = np.minimum(np.minimum(rn, mn), tn)
        sid = wire.as_int32(role)[within(rn, n)]
        ids = wire.running_by(wire.zigzag_decoded(ref), mn, "members")[within(mn, n)]
        types = wire.as_int32(kind)[within(tn, n)]
        if len(types) and (types.min() < 0 or types.max() > 2):
            raise BadMessage("relation", f"unknown member type {int(types[(types < 0) | (types > 2)][0])}")
        ok = block.strings.valid(sid)
        parts = [pa.array(MEMBER_TYPES).take(pa.array(types)), pa.array(ids), block.strings.take(sid, ok), pa.array(sid, pa.int32()), block.strings.errors(sid, ok)]
        out["members"] = lists(pa.StructArray.from_arrays(parts, fields=list(model.P_MEMBER)), n)
    return out


#: Columns that need no element to be decoded, only counted.
PLACES = {"path", "blob_offset", "group_idx", "elem_idx", "kind", "is_dense"}


def count_dense(block: Block, a: int, b: int | None) -> int:
    """Dense nodes of a message: the shortest of its id, lat and lon lists."""
    size = {1: 0, 8: 0, 9: 0}
    for number, kind, x, y in fields(block.data, a, b, "dense nodes"):
        if number in size:
            size[number] += int(np.count_nonzero(np.frombuffer(block.data, np.uint8, y - x, x) < 128)) if kind == BYTES else 1
    return min(size.values())


def decode_block(data: bytes, path: str, offset: int, columns: Sequence[str], kinds: set[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a block's elements in file order: in each group dense nodes, nodes, ways, relations.

    Where no column of ``columns`` needs it, elements are only counted, and what is wrong inside them goes unnoticed.
    """
    block, want = Block(data), set(columns)
    for g, (a, b) in enumerate(block.groups):
        spans: dict[int, list[tuple[int, int]]] = {1: [], 2: [], 3: [], 4: []}
        for number, kind, x, y in fields(data, a, b, "group"):
            if number in spans and kind == BYTES:
                spans[number].append((x, y))
        parts = []
        if spans[2]:  # several dense messages are one: their bytes are merged
            x, y = spans[2][0] if len(spans[2]) == 1 else (None, None)
            whole = (block, x, y) if x is not None else (_merged(block, spans[2]), 0, None)
            parts.append(("node", True, lambda whole=whole: dense_nodes(*whole, want), lambda whole=whole: count_dense(*whole)))
        for number, name, read in ((1, "node", plain_nodes), (3, "way", ways), (4, "relation", relations)):
            if spans[number]:
                parts.append((name, False, lambda number=number, read=read: read(block, spans[number], want), lambda number=number: len(spans[number])))
        before = 0
        for name, dense, read, count in parts:
            if name not in kinds and "elem_idx" not in want:
                continue
            cols = read() if name in kinds and not want <= PLACES else {}
            n = len(cols["id"]) if cols else count()
            if name in kinds and n:
                fixed = {
                    "path": lambda: pa.repeat(pa.scalar(path), n), "blob_offset": lambda: pa.array(np.full(n, offset)), "group_idx": lambda: pa.array(np.full(n, g, np.int32)),
                    "elem_idx": lambda: pa.array(np.arange(before, before + n, dtype=np.int32)), "kind": lambda: pa.repeat(pa.scalar(name), n), "is_dense": lambda: pa.array(np.full(n, dense)),
                }
                made = [fixed[c]() if c in fixed else cols[c] if c in cols else pa.nulls(n, model.ARROW[c]) for c in columns]
                yield pa.RecordBatch.from_arrays([m.cast(model.ARROW[c]) if m.type != model.ARROW[c] else m for c, m in zip(columns, made)], list(columns))
            before += n


def _merged(block: Block, spans: list[tuple[int, int]]) -> Block:
    other = Block.__new__(Block)
    other.__dict__.update(block.__dict__)
    other.data = b"".join(block.data[a:b] for a, b in spans)
    return other


def decode_header(data: bytes) -> dict:
    """The fields of a header block; bounding box in degrees, unset fields None."""
    out: dict = {"bbox": None, "required_features": [], "optional_features": [], "writing_program": None, "source": None, "replication_timestamp": None, "replication_sequence_number": None, "replication_base_url": None}
    texts = {4: "required_features", 5: "optional_features", 16: "writing_program", 17: "source", 34: "replication_base_url"}
    for number, kind, a, b in fields(data, where="header block"):
        if number == 1 and kind == BYTES:
            v = {n: wire.unzigzag(x) for n, k, x, _ in fields(data, a, b, "bbox") if k == VARINT}
            if not {1, 2, 3, 4} <= set(v):
                raise BadMessage("bbox", "a required field is missing")
            out["bbox"] = {name: 1e-9 * v[i] for i, name in enumerate(("left", "right", "top", "bottom"), 1)}
        elif number in texts and kind == BYTES:
            try:
                text = data[a:b].decode()
            except UnicodeDecodeError as e:
                raise BadMessage("header block", "a text is not UTF-8") from e
            if number in (4, 5):
                out[texts[number]].append(text)
            else:
                out[texts[number]] = text
        elif number in (32, 33) and kind == VARINT:
            out["replication_timestamp" if number == 32 else "replication_sequence_number"] = wire.signed(a)
    return out


def string_table(data: bytes) -> list[bytes]:
    return Block(data).strings.raw
