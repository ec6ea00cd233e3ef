"""Spark sources, the sink, the facade and the stream on small extracts."""

import struct

import pytest
from pyspark.sql import functions as F

from stratamap.dataset import Extract
from stratamap.functions import decimicro, degrees, deleted, has_tag, tag
from stratamap.operators import extract
from stratamap.sources import datasource, encode, errors, framing
from stratamap.sources.encode import Layout
from stratamap.sources.wire import put_bytes, put_number
from tests.test_codec import GOLDEN, golden, info, node, tags


@pytest.fixture
def golden_file(tmp_path):
    p = tmp_path / "a.pbf"
    p.write_bytes(encode.encode_file(golden()))
    return str(p)


def test_tables_of_the_golden_extract(spark, golden_file):
    x = Extract(spark, golden_file)
    assert {r.kind: r.n for r in x.count_by_kind().collect()} == {"node": 3, "way": 1, "relation": 1}
    n = x.nodes(["id", "nano_lat", "nano_lon"]).select("id", degrees("nano_lat").alias("lat"), decimicro("nano_lat").alias("d")).orderBy("id").collect()
    assert [(r.id, r.lat, r.d) for r in n] == [(i, 1e-9 * a, a // 100) for i, a, _ in GOLDEN]
    deps = x.ways_and_deps(has_tag("building", "yes"))
    assert sorted((r.kind, r.id) for r in deps.collect()) == [("node", 105), ("node", 106), ("node", 108), ("way", 107)]
    assert [tuple(r) for r in x.way_refs().orderBy("pos").collect()] == [(107, 0, 105), (107, 1, 106), (107, 2, 108), (107, 3, 105)]
    assert x.relation_members().first().role == "test_role"
    assert {(r.kind, r.key, r.value) for r in x.tags().collect()} == {("way", "building", "yes"), ("way", "name", "triangle"), ("relation", "rel_key", "rel_value")}
    assert x.header_has("DenseNodes").count() == 1 and x.header_has("Nothing").count() == 0
    assert [r.blob_type for r in x.blobs().orderBy("blob_seq").collect()] == ["OSMHeader", "OSMData", "OSMData", "OSMData"]
    seen = []
    x.for_each(lambda r: seen.append((r.kind, r.id)))
    assert seen == [("node", 105), ("node", 106), ("node", 108), ("way", 107), ("relation", 120)]
    assert x.map_reduce(lambda b: b.num_rows, 0, lambda a, b: a + b, ["id"]) == 5
    assert x.nodes(["id", "info"]).filter(deleted()).count() == 0


def test_reused_scan_keeps_no_filter(spark, golden_file):
    d = Extract(spark, golden_file).elements(["kind", "id"])
    assert d.filter("kind = 'way'").count() == 1 and d.count() == 5
    assert d.filter("kind = 'way'").union(d).count() == 6


def test_column_selective_schema(spark, golden_file):
    d = Extract(spark, golden_file).elements(["id", "tags"], ("way",))
    assert d.columns == ["id", "tags"] and d.first().id == 107
    with pytest.raises(Exception, match="unknown"):
        Extract(spark, golden_file).elements(["nope"]).collect()


def test_random_access_and_wrong_types(spark, golden_file):
    x = Extract(spark, golden_file)
    heads = list(framing.scan_heads(golden_file))
    assert [r.id for r in x.elements(["id"], offsets=[(golden_file, heads[2].offset)]).collect()] == [107]
    read = lambda fmt, **o: spark.read.format(fmt).options(**o).load(golden_file).collect()
    with pytest.raises(Exception, match="ExtractError"):
        read("strata_header", offsets=str(heads[1].offset))
    with pytest.raises(Exception, match="ExtractError"):
        read("strata_strings", offsets=str(heads[0].offset))
    with pytest.raises(Exception, match="Error|Eof|BadMessage|HeaderTooBig"):
        read("strata_elements", offsets="1")
    with pytest.raises(Exception, match="UnexpectedEof"):
        read("strata_elements", offsets="99999999")
    assert len(read("strata_elements", start_offset=str(heads[2].offset))) == 2
    with pytest.raises(Exception, match="UnexpectedEof"):
        read("strata_elements", start_offset="99999999")


@pytest.mark.parametrize("content", [b"", encode.blob("OSMHeader", encode.header_message())])
def test_empty_extracts(spark, tmp_path, content):
    (tmp_path / "e.pbf").write_bytes(content)
    x = Extract(spark, str(tmp_path / "e.pbf"))
    assert x.elements().count() == 0 and len(x.elements().columns) == 16
    assert x.map_reduce(lambda b: b.num_rows, 0, lambda a, b: a + b) == 0
    assert x.ways_and_deps(F.lit(True), pruned=True).count() == 0
    assert [tuple(r) for r in extract.count_row(x.elements(["kind"])).collect()] == [(0, 0, 0)]


def test_foreign_blobs_and_bad_blocks(spark, tmp_path):
    good = encode.encode_file(golden())
    (tmp_path / "f.pbf").write_bytes(good + encode.blob("Other", b"anything") + b"".join(encode.encode_blocks([node(9, 0, 0)], Layout())))
    assert Extract(spark, str(tmp_path / "f.pbf")).elements(["id"]).count() == 6
    (tmp_path / "g.pbf").write_bytes(good + encode.frame("Other", b"\xff"))
    with pytest.raises(Exception, match="BadMessage"):
        Extract(spark, str(tmp_path / "g.pbf")).elements(["id"]).count()
    assert Extract(spark, str(tmp_path / "g.pbf"), framing="strict").elements(["id"]).count() == 5
    (tmp_path / "h.pbf").write_bytes(good + encode.frame("OSMData", b""))
    with pytest.raises(Exception, match="EmptyBlob"):
        Extract(spark, str(tmp_path / "h.pbf")).elements(["id"]).count()


def test_versions_of_a_node_and_ids_of_other_kinds(spark, tmp_path):
    rows = [node(7, 0, 0), node(7, 100, 0, info=info(version=2)), {"kind": "way", "id": 7, "refs": [7, 7, 999], "tags": tags(a="b", **{"c": "d"}), "info": None}]
    (tmp_path / "v.pbf").write_bytes(encode.encode_file(rows))
    got = Extract(spark, str(tmp_path / "v.pbf")).ways_and_deps(has_tag("a"))
    assert sorted((r.kind, r.id) for r in got.collect()) == [("node", 7), ("node", 7), ("way", 7)]


def test_first_of_duplicate_tags(spark, tmp_path):
    way = {"kind": "way", "id": 1, "refs": [], "tags": [*tags(a="1"), *tags(a="2")], "info": None}
    (tmp_path / "t.pbf").write_bytes(encode.encode_file([way]))
    r = Extract(spark, str(tmp_path / "t.pbf")).ways(["tags"]).select("tags", tag("a").alias("a"), tag("x").alias("x")).first()
    assert len(r.tags) == 2 and r.a == "1" and r.x is None


def test_sink_round_trip(spark, tmp_path, golden_file):
    x = Extract(spark, golden_file)
    out = str(tmp_path / "out")
    x.elements().coalesce(1).write.format("strata_elements").mode("append").option("compression", "raw").save(out)
    key = lambda r: (r["kind"], r["id"])
    drop = lambda rows: sorted(({k: v for k, v in r.asDict(True).items() if k not in ("path", "blob_offset", "group_idx", "elem_idx", "raw_tags", "members")} for r in rows), key=key)
    assert drop(Extract(spark, out).elements().collect()) == drop(x.elements().collect())
    x.nodes().write.format("strata_elements").mode("overwrite").save(out)
    assert Extract(spark, out).elements(["id"]).count() == 3


def test_many_files_are_framed_by_tasks(spark, tmp_path):
    for i in range(datasource.SCAN_IN_TASKS):
        (tmp_path / f"{i}.pbf").write_bytes(encode.encode_file([node(i, 0, 0)]))
    assert Extract(spark, str(tmp_path)).elements(["id"]).distinct().count() == datasource.SCAN_IN_TASKS
    assert Extract(spark, f"{tmp_path}/1*.pbf").elements(["id"]).count() == 11


def test_splits_follow_blobs(tmp_path):
    p = tmp_path / "s.pbf"
    p.write_bytes(encode.encode_file([node(i, i * 100, 0) for i in range(50)], Layout(block_size=5)))
    r = datasource.ElementReader({"path": str(p), "split_bytes": "200"})
    parts = r.partitions()
    assert len(parts) > 3 and sum(len(s.heads) for s in parts) == 11
    assert sum(b.num_rows for s in parts for b in r.read(s)) == 50


@pytest.mark.parametrize("compression", ["zlib", "raw"])
def test_ranges_of_bytes_share_out_all_blobs(tmp_path, compression):
    """Every cut finds each blob once, also with a file inside a raw blob, an odd header, and bytes left over at the end."""
    inner = encode.encode_file([node(i, 0, 0) for i in range(4)], Layout(block_size=1, compression="raw"))
    odd = put_number(3, 3) + put_bytes(1, b"odd")
    data = b"".join([
        encode.encode_file([node(i, i * 100, 0) for i in range(60)], Layout(block_size=5, compression=compression)), encode.blob("other", inner + bytes(50), "raw"),
        struct.pack(">I", len(odd)) + odd + b"\0\0\0", encode.encode_file([node(i, 0, 0) for i in range(60, 90)], Layout(block_size=7, compression=compression)),
    ])
    p = tmp_path / "r.pbf"
    for tail in (b"", b"\0\0"):
        p.write_bytes(data + tail)
        whole = list(framing.scan_heads(str(p)))
        for size in (5, 37, 256, 1000, 10**6):
            r = datasource.ElementReader({"path": str(p), "range_bytes": str(size)})
            assert [h for s in r.ranges([str(p)]) for h in r.found(str(p), s)] == whole
        start = whole[4].offset
        r = datasource.ElementReader({"path": str(p), "range_bytes": "100", "start_offset": str(start)})
        assert [h for s in r.ranges([str(p)]) for h in r.found(str(p), s)] == whole[4:]
    with pytest.raises(errors.InvalidHeaderSize):
        r = datasource.ElementReader({"path": str(p), "range_bytes": "100", "framing": "strict"})
        assert [h for s in r.ranges([str(p)]) for h in r.found(str(p), s)]


def test_many_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    for i in range(datasource.SCAN_IN_TASKS):
        (tmp_path / f"{i}.pbf").write_bytes(encode.encode_file([node(100 * i + k, 0, 0) for k in range(40)], Layout(block_size=4)))
    x = Extract(spark, str(tmp_path), range_bytes="300")
    assert x.elements(["id"]).distinct().count() == 40 * datasource.SCAN_IN_TASKS and x.elements(["id"]).rdd.getNumPartitions() > 3 * datasource.SCAN_IN_TASKS


def test_counting_decodes_nothing(spark, tmp_path, golden_file):
    from stratamap.sources import blocks

    for cols in (["kind"], ["kind", "is_dense", "group_idx", "elem_idx"]):
        x = Extract(spark, golden_file)
        assert sorted(tuple(r) for r in x.elements(cols).collect()) == sorted(tuple(r[c] for c in cols) for r in x.elements().collect())
    assert {"id", "tags", "info"}.isdisjoint(blocks.PLACES)


def test_stream_of_extracts(spark, tmp_path):
    from stratamap.streaming import stream_elements

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pbf").write_bytes(encode.encode_file(golden()))
    q = stream_elements(spark, str(folder), ["kind", "id"], ("node", "way")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (folder / "b.pbf").write_bytes(encode.encode_file([node(1, 0, 0)]))
        q.processAllAvailable()
        assert sorted((r.kind, r.id) for r in spark.table("arrived").collect()) == [("node", 1), ("node", 105), ("node", 106), ("node", 108), ("way", 107)]
    finally:
        q.stop()


RANGES = [(None, None), (0, 0), (1, 1), (2, 2), (3, 3), (3, 5), (3, 6), (6, 6), (7, 7), (0, 1), (2, 9), (-5, 0), (-5, 10), (7, 99), (4, 4)]


def test_id_ranges_against_a_set(spark):
    zones = spark.createDataFrame([("p", i, "node", a, b) for i, (a, b) in enumerate(RANGES)] + [("p", 99, "way", 1, 2)], "path string, blob_offset bigint, kind string, min_id bigint, max_id bigint")
    ids = spark.createDataFrame([(1,), (2,), (6,), (6,), (None,)], "id bigint")
    want = [("p", i) for i, (a, b) in enumerate(RANGES) if a is not None and any(a <= x <= b for x in (1, 2, 6))]
    held = extract.held_zones(zones)
    assert extract.zones_hit(held, ids) == want
    assert extract.zones_hit(held, ids.limit(0)) == [] and extract.zones_hit([], ids) == []


def test_availability_of_kinds(spark, golden_file):
    x = Extract(spark, golden_file)
    assert {k: x.blobs_with(k).count() for k in ("node", "way", "relation")} == {"node": 1, "way": 1, "relation": 1}
    z = x.blobs_with("node").first()
    assert (z.min_id, z.max_id, z.n) == (105, 108, 3)


def test_arrow_file_systems(spark, tmp_path, golden_file, monkeypatch):
    """The path that remote files take, by way of Arrow's own file scheme."""
    from stratamap.sources import files

    monkeypatch.setattr(files, "local_path", lambda p: None if "://" in p else p)
    folder = tmp_path.as_uri()
    assert files.list_files(f"{folder}/*.pbf") == files.list_files(folder) == [f"{folder}/a.pbf"] == files.list_files(f"{folder}/a.pbf")
    with pytest.raises(FileNotFoundError):
        files.list_files(f"{folder}/none.pbf")
    assert [h.blob_type for h in framing.scan_heads(f"{folder}/a.pbf")] == ["OSMHeader", "OSMData", "OSMData", "OSMData"]
    r = datasource.ElementReader({"path": folder, "columns": "id"})
    assert sum(b.num_rows for s in r.partitions() for b in r.read(s)) == 5
    out = files.Folder(f"{folder}/new")
    with out.create(".x") as f:
        f.write(b"1")
    out.rename(".x", "x")
    assert out.names() == ["x"]
    out.delete("x")
    assert out.names() == []
