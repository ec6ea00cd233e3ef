"""Framing and decoding of hand-made and random blocks."""

import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratamap.sources import blocks, encode, errors, framing, model, wire
from stratamap.sources.encode import Layout, put_bytes, put_number, put_packed, zigzag

ALL = list(model.ELEMENTS)


def tags(**kw):
    return [{"key": k, "value": v} for k, v in kw.items()]


def info(**kw):
    return {"version": 1, "timestamp_ms": 1049522828000, "changeset": 5, "uid": 17, "user": "testuser", "visible": True} | kw


def node(id, lat, lon, dense=True, **kw):
    return {"kind": "node", "is_dense": dense, "id": id, "nano_lat": lat, "nano_lon": lon, "tags": [], "info": info()} | kw


GOLDEN = [(105, 52122403100, 11628401700), (106, 52119923500, 11625644600), (108, 52119899100, 11631019200)]


def golden(dense=True):
    return [
        *[node(i, a, o, dense) for i, a, o in GOLDEN],
        {"kind": "way", "id": 107, "tags": tags(building="yes", name="triangle"), "refs": [105, 106, 108, 105], "info": info()},
        {"kind": "relation", "id": 120, "tags": tags(rel_key="rel_value"), "members": [{"member_type": "way", "member_id": 107, "role": "test_role"}], "info": info()},
    ]


def decode(message, kinds=model.KINDS, columns=ALL):
    return [r for b in blocks.decode_block(message, "p", 0, columns, set(kinds)) for r in b.to_pylist()]


def decode_file(data, strict=True, kinds=model.KINDS):
    f = io.BytesIO(data)
    out = []
    while (h := framing.read_head(f, strict)) is not None:
        body = framing.read_body(f, h, strict)
        if h.blob_type == "OSMData":
            out += [r for b in blocks.decode_block(framing.payload(body), "p", h.offset, ALL, set(kinds)) for r in b.to_pylist()]
        f.seek(h.body + h.datasize)
    return out


def block(groups=b"", strings=(b"", b"k", b"v"), tail=b""):
    return put_bytes(1, b"".join(put_bytes(1, s) for s in strings)) + groups + tail


@pytest.mark.parametrize("compression", ["zlib", "raw"])
@pytest.mark.parametrize("dense", [True, False])
def test_golden_file_in_every_form(compression, dense):
    rows = decode_file(encode.encode_file(golden(dense), Layout(compression)))
    assert [(r["kind"], r["id"]) for r in rows] == [("node", 105), ("node", 106), ("node", 108), ("way", 107), ("relation", 120)]
    assert [(r["id"], r["nano_lat"], r["nano_lon"]) for r in rows[:3]] == GOLDEN
    assert [r["is_dense"] for r in rows[:3]] == [dense] * 3
    assert rows[3]["refs"] == [105, 106, 108, 105] and rows[3]["raw_refs"] == [105, 1, 2, -3] and rows[3]["node_locations"] == []
    assert rows[3]["tags"] == tags(building="yes", name="triangle")
    assert rows[4]["members"][0] | {"role_sid": 0} == {"member_type": "way", "member_id": 107, "role": "test_role", "role_sid": 0, "role_error": None}
    assert all(r["info"]["uid"] == 17 and r["info"]["visible"] and r["info"]["timestamp_ms"] == 1049522828000 for r in rows)


def test_locations_on_ways_close_the_ring():
    places = [{"nano_lat": a, "nano_lon": o} for _, a, o in GOLDEN]
    way = {"kind": "way", "id": 107, "tags": [], "refs": [105, 106, 108, 105], "node_locations": [*places, places[0]], "info": None}
    assert decode_file(encode.encode_file([way]))[0]["node_locations"] == [*places, places[0]]


def test_deleted_nodes_of_a_history():
    rows = decode_file(encode.encode_file([node(1, 0, 0, info=info(visible=False)), node(1, 100, 0, info=info(version=2))]))
    assert [r["info"]["visible"] for r in rows] == [False, True]


def test_header_fields():
    h = blocks.decode_header(encode.header_message(optional=("LocationsOnWays",), source="s", bbox=(-1_000_000_000, 2, 3, 4), replication=(12, 34, "u")))
    assert h["bbox"]["left"] == 1e-9 * -1_000_000_000 and h["required_features"] == ["OsmSchema-V0.6", "DenseNodes"] and h["optional_features"] == ["LocationsOnWays"]
    assert (h["replication_timestamp"], h["replication_sequence_number"], h["replication_base_url"], h["source"]) == (12, 34, "u", "s")
    assert blocks.decode_header(b"")["writing_program"] is None
    with pytest.raises(errors.BadMessage):
        blocks.decode_header(put_bytes(1, put_number(1, 2)))


def test_header_limit():
    with pytest.raises(errors.HeaderTooBig):
        framing.read_head(io.BytesIO(struct.pack(">I", 65536) + bytes(65536)), False)
    head = put_bytes(1, b"OSMData") + put_number(3, 0)
    head += put_bytes(2, bytes(65535 - len(head) - 4))
    assert len(head) == 65535
    assert framing.read_head(io.BytesIO(struct.pack(">I", 65535) + head), True).blob_type == "OSMData"


def test_payload_limits_and_kinds():
    with pytest.raises(errors.MessageTooBig):
        framing.payload(put_bytes(1, bytes(1 << 25)))
    with pytest.raises(errors.MessageTooBig):
        framing.payload(put_bytes(3, zlib.compress(bytes(1 << 26))))
    with pytest.raises(errors.BadMessage):
        framing.payload(put_bytes(3, zlib.compress(b"x" * 1000)[:-3]))
    for field in (4, 5, 6, 7):
        with pytest.raises(errors.EmptyBlob):
            framing.payload(put_bytes(field, b"x"))
    with pytest.raises(errors.EmptyBlob):
        framing.payload(b"")


@pytest.mark.parametrize("tail", [b"\0", b"\0\0", b"\0\0\0"])
def test_trailing_bytes(tail):
    data = encode.encode_file(golden()) + tail
    assert len(decode_file(data, strict=False)) == 5
    with pytest.raises(errors.InvalidHeaderSize):
        decode_file(data, strict=True)


def test_truncation():
    data = encode.encode_file(golden())
    for cut in (1, 20):
        with pytest.raises(errors.ExtractError):
            decode_file(data[:-cut], strict=False)
        with pytest.raises(errors.UnexpectedEof):
            decode_file(data[:-cut], strict=True)
    with pytest.raises(errors.ExtractError):
        decode_file(data[:8], strict=False)
    with pytest.raises(errors.UnexpectedEof):
        decode_file(data[:8], strict=True)


def test_negative_datasize_and_missing_type():
    with pytest.raises(errors.BadMessage):
        framing.parse_head(put_bytes(1, b"OSMData") + put_number(3, -5), 0)
    with pytest.raises(errors.BadMessage):
        framing.parse_head(put_number(3, 5), 0)


def test_tags_end_at_the_first_bad_pair():
    strings = (b"", b"k", b"v", b"\xff")
    for bad in (9, 3):
        body = put_number(1, zigzag(1)) + put_packed(2, [1, 1, 1]) + put_packed(3, [2, bad, 2]) + put_number(8, 0) + put_number(9, 0)
        r = decode(block(put_bytes(2, put_bytes(1, body)), strings))[0]
        assert r["tags"] == tags(k="v") and len(r["raw_tags"]) == 3


def test_surplus_keys_are_no_tags_and_missing_info_is_empty():
    body = put_number(1, zigzag(-7)) + put_packed(2, [1, 1]) + put_packed(3, [2]) + put_number(8, zigzag(-3)) + put_number(9, 0)
    r = decode(block(put_bytes(2, put_bytes(1, body)), tail=put_number(17, 10) + put_number(19, 1) + put_number(20, -1)))[0]
    assert r["id"] == -7 and r["tags"] == tags(k="v") and (r["nano_lat"], r["nano_lon"]) == (-29, -1)
    assert r["info"] == {"version": None, "timestamp_ms": None, "changeset": None, "uid": None, "user": None, "user_error": None, "visible": True}


def dense(ids, kv=(), info_part=None, lat=None, lon=None):
    out = put_packed(1, encode.deltas(ids), True) + put_packed(8, lat if lat is not None else [0] * len(ids), True) + put_packed(9, lon if lon is not None else [0] * len(ids), True)
    return put_bytes(2, put_bytes(2, out + (put_bytes(5, info_part) if info_part is not None else b"") + put_packed(10, kv)))


def test_dense_tag_delimiters():
    get = lambda kv, n=3: [[(t["key"], t["value"]) for t in r["tags"]] for r in decode(block(dense(list(range(n)), kv)))]
    assert get([]) == [[], [], []]
    assert get([1, 2, 0]) == [[("k", "v")], [], []]
    assert get([0, 1, 2, 0, 0]) == [[], [("k", "v")], []]
    assert get([1, 0, 0, 1, 2, 0]) == [[("k", "")], [("k", "v")], []]
    assert get([1, 2, 1, 0, 0, 0]) == [[("k", "v"), ("k", "")], [], []]
    assert get([0, 1]) == [[], [], []]
    assert get([1, 2, 0, 1, 2, 0, 1, 2, 0, 1, 2, 0]) == [[("k", "v")]] * 3


def test_dense_rows_and_info_lengths():
    part = put_packed(1, [1, 2]) + put_packed(2, [1, 1], True) + put_packed(3, [1, 1], True) + put_packed(4, [1, 1], True) + put_packed(5, [1, 8], True) + put_packed(6, [0])
    rows = decode(block(dense([5, 6, 7], info_part=part, lat=[1, 1, 1, 1])))
    assert [r["id"] for r in rows] == [5, 6, 7] and rows[2]["info"] is None
    assert [r["info"]["visible"] for r in rows[:2]] == [False, True]
    assert [r["info"]["timestamp_ms"] for r in rows[:2]] == [1000, 2000]
    assert rows[0]["info"]["user"] == "k" and rows[1]["info"]["user"] is None and rows[1]["info"]["user_error"] == "StringIndexOutOfBounds: 9"
    assert all(r["info"] is None for r in decode(block(dense([1, 2]))))
    assert len(decode(block(dense([1, 2, 3], lat=[0])))) == 1


def test_relation_lists_are_zipped_and_roles_fail_alone():
    body = put_number(1, 1) + put_packed(8, [1, 9, 3]) + put_packed(9, [5, 5, 5, 5], True) + put_packed(10, [0, 1, 2, 0])
    m = decode(block(put_bytes(2, put_bytes(4, body)), (b"", b"r", b"v", b"\xff")))[0]["members"]
    assert [(x["member_type"], x["member_id"], x["role"], x["role_error"]) for x in m] == [("node", 5, "r", None), ("way", 10, None, "StringIndexOutOfBounds: 9"), ("relation", 15, None, "StringNotUtf8: 3")]
    with pytest.raises(errors.BadMessage, match="member type 7"):
        decode(block(put_bytes(2, put_bytes(4, put_number(1, 1) + put_packed(8, [1]) + put_packed(9, [1], True) + put_packed(10, [7])))))


def test_mixed_group_order_and_ignored_changesets():
    n = put_bytes(1, put_number(1, zigzag(1)) + put_number(8, 0) + put_number(9, 0))
    d = put_bytes(2, put_packed(1, [2], True) + put_packed(8, [0], True) + put_packed(9, [0], True))
    g = put_bytes(2, n + put_bytes(4, put_number(1, 4)) + put_bytes(3, put_number(1, 3)) + d + put_bytes(5, put_number(1, 9)))
    rows = decode(block(g))
    assert [(r["kind"], r["is_dense"], r["id"], r["elem_idx"]) for r in rows] == [("node", True, 2, 0), ("node", False, 1, 1), ("way", False, 3, 2), ("relation", False, 4, 3)]
    assert [r["elem_idx"] for r in decode(block(g), ("way",))] == [2]


def test_missing_required_fields_and_garbage():
    for g in (put_bytes(3, b""), put_bytes(1, put_number(1, 2)), put_bytes(4, put_bytes(2, b""))):
        with pytest.raises(errors.BadMessage):
            decode(block(put_bytes(2, g)))
    with pytest.raises(errors.BadMessage):
        decode(put_number(17, 100))
    with pytest.raises(errors.BadMessage):
        decode(b"\x0a\x7f")
    assert decode(block()) == []


def test_overflow_is_an_error():
    with pytest.raises(errors.BadMessage):
        decode(block(dense([0, 1], lat=[(1 << 62), (1 << 62)])))


ids = st.integers(-(1 << 40), 1 << 40)
text = st.text(st.characters(codec="utf-8"), max_size=6)
pairs = st.lists(st.fixed_dictionaries({"key": text.filter(bool), "value": text}), max_size=4)
infos = st.fixed_dictionaries({"version": st.integers(0, 1000), "timestamp_ms": st.integers(0, 1 << 31).map(lambda x: x * 1000), "changeset": ids, "uid": st.integers(-9, 1 << 30), "user": text, "visible": st.booleans()})
coord = st.integers(-(1 << 30), 1 << 30).map(lambda x: x * 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.fixed_dictionaries({"id": ids, "nano_lat": coord, "nano_lon": coord, "tags": pairs, "info": infos}), max_size=8), st.booleans(), st.lists(st.lists(ids, max_size=6), max_size=5))
def test_round_trip(nodes, is_dense, refs):
    rows = [{"kind": "node", "is_dense": is_dense, **n} for n in nodes] + [{"kind": "way", "id": i, "refs": r, "tags": [], "info": None} for i, r in enumerate(refs)]
    back = decode_file(encode.encode_file(rows, Layout(block_size=3)))
    assert len(back) == len(rows)
    for a, b in zip(rows, back):
        for k in a:
            if k == "info" and a[k] is None:
                continue
            assert (b[k] | {"user_error": None} if k == "info" else b[k]) == (a[k] | {"user_error": None} if k == "info" else bool(a[k]) if k == "is_dense" else a[k]), k


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1)))
def test_packed_numbers(values):
    for zig in (False, True):
        buf = put_packed(1, values, zig)
        if values:
            ((_, _, a, b),) = wire.fields(buf)
            v = wire.varints(buf[a:b])
            assert (wire.zigzag_decoded(v) if zig else wire.as_signed(v)).tolist() == values
        else:
            assert buf == b""


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_garbage_raises_only_typed_errors(data):
    for f in (lambda: decode(data), lambda: decode_file(data, False), lambda: decode_file(data, True), lambda: blocks.decode_header(data), lambda: framing.payload(data)):
        try:
            f()
        except errors.ExtractError:
            pass


def test_running_sums_by_list():
    assert wire.running_by(np.array([1, 2, 3, 4]), np.array([2, 0, 2]), "x").tolist() == [1, 3, 3, 7]
