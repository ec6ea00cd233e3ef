"""Queries on the format itself: hand-made extracts whose rows, fields and failures are known."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamap.dataset import Extract
from stratamap.session import scratch, ship_package
from stratamap.sources import datasource
from stratamap.sources.encode import Layout, blob, encode_blocks, frame, header_message
from stratamap.sources.files import Folder
from stratamap.sources.fixtures import extract_of
from stratamap.sources.framing import DATA_TYPE, FRAMINGS, HEADER_TYPE
from stratamap.sources.wire import put_bytes, put_number


def _nodes(n: int, size: int = 8000) -> list[bytes]:
    rows = [{"kind": "node", "is_dense": True, "id": i, "nano_lat": 100 * i, "nano_lon": -100 * i, "tags": [], "info": None} for i in range(n)]
    return list(encode_blocks(iter(rows), Layout(block_size=size)))


def _fixtures() -> dict[str, bytes]:
    """Extracts of five nodes in every state of framing."""
    head, data = blob(HEADER_TYPE, header_message()), b"".join(_nodes(5))
    whole = head + data
    return {
        "whole": whole, "empty file": b"", "header only": head, **{f"{n} bytes left over": whole + bytes(n) for n in (1, 2, 3)}, "header cut off": whole[:8], "body cut off": whole[:-1],
        "header of 65536 bytes": whole + struct.pack(">I", 65536) + bytes(65536), "header of 65535 bytes": whole + struct.pack(">I", 65535) + (h := put_bytes(1, b"padded") + put_number(3, 0)) + put_bytes(2, bytes(65535 - len(h) - 4)),
        "other blob between": head + blob("other", b"anything") + data, "negative datasize": whole + struct.pack(">I", 20) + put_bytes(1, DATA_TYPE.encode()) + put_number(3, -5),
        "no payload": head + frame(DATA_TYPE, b""), "lz4 payload": head + frame(DATA_TYPE, put_bytes(6, b"x")), "payload cut off": head + frame(DATA_TYPE, put_bytes(3, zlib.compress(bytes(1000))[:-3])),
        "payload above 32 MiB": head + frame(DATA_TYPE, put_bytes(3, zlib.compress(bytes((1 << 25) + 1)))), "no string table": head + blob(DATA_TYPE, put_bytes(2, b"")),
    }


def _written(spark: SparkSession, files: dict[str, bytes]) -> str:
    ship_package(spark)
    path = scratch(spark, "format")
    folder = Folder(path)
    for name, content in files.items():
        with folder.create(f"{name.replace(' ', '_')}.pbf") as f:
            f.write(content)
    return path


def _outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        said = []
        for path, framing in zip(pdf["path"], pdf["framing"]):
            try:
                reader = datasource.ElementReader({"path": path, "framing": framing, "columns": "id"})
                said.append(f"{sum(b.num_rows for s in reader.partitions() for b in reader.read(s))} elements")
            except Exception as e:  # noqa: BLE001 - its name is the result
                said.append(type(e).__name__)
        yield pd.DataFrame({"fixture": pdf["fixture"], "framing": pdf["framing"], "outcome": said})


def framing_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What reading each hand-made extract gives under either framing: the number of elements or the failure's name."""
    files = _fixtures()
    folder = _written(spark, files)
    rows = [(name, f, f"{folder}/{name.replace(' ', '_')}.pbf") for name in files for f in FRAMINGS]
    return spark.createDataFrame(rows, "fixture string, framing string, path string").mapInPandas(_outcomes, "fixture string, framing string, outcome string")


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of a header block, set in one file and left out in another; a number that is left out is -1 here."""
    full = header_message(("OsmSchema-V0.6",), ("Sort.Type_then_ID",), "writer", "survey", (-1_500_000_000, 2_000_000_000, 52_000_000_001, 51_000_000_000), (1700000000, 42, "https://example.org/replication"))
    folder = _written(spark, {"a full": blob(HEADER_TYPE, full), "b bare": blob(HEADER_TYPE, header_message((), (), None))})
    h = Extract(spark, folder).header()
    return h.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "bbox.left", "bbox.right", "bbox.top", "bbox.bottom", F.array_join("required_features", ",").alias("required"), F.array_join("optional_features", ",").alias("optional"),
        "writing_program", "source", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("replication_timestamp", "replication_sequence_number")], "replication_base_url",
    )


def seek_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nodes read from an offset on, from named blobs only, and by ranges of bytes: all are the rows that stand there."""
    x = Extract(spark, f"{_written(spark, {'s': blob(HEADER_TYPE, header_message()) + b''.join(_nodes(12, 3))})}/s.pbf")
    blobs = x.index()
    read = lambda how, **o: Extract(spark, x.path, **o).nodes(["id"]).select(F.lit(how).alias("how"), "id")
    named = x.nodes(["id"], offsets=[(blobs[i].path, blobs[i].blob_offset) for i in (2, 4)]).select(F.lit("named").alias("how"), "id")
    return read("start", start_offset=str(blobs[3].blob_offset)).unionByName(named).unionByName(read("split", split_bytes="1"))


def for_each_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements visited one by one in file order: their number and sum of ids per kind, and whether the order held."""
    seen: dict[str, list[int]] = {}
    last: list[tuple] = [()]
    ordered = [True]

    def visit(row) -> None:
        n = seen.setdefault(row.kind, [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + row.id
        place = (row.path, row.blob_offset, row.group_idx, row.elem_idx)
        ordered[0] &= last[0] <= place
        last[0] = place

    Extract(spark, extract_of(spark, d, "main")).for_each(visit, columns=["path", "blob_offset", "group_idx", "elem_idx", "kind", "id"])
    return spark.createDataFrame([(k, n, total, ordered[0]) for k, (n, total) in seen.items()], "kind string, n bigint, id_sum bigint, in_order boolean")


def blob_chain(spark: SparkSession, d: str) -> DataFrame:
    """Blobs of the index that do not begin where the one before ends, and files that do not begin with a header: none."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("blob_offset")
    b = Extract(spark, extract_of(spark, d, "main")).blobs().withColumn("before", F.lag(F.expr("blob_offset + 4 + header_size + datasize")).over(w))
    bad = F.when(F.col("before").isNull(), (F.col("blob_offset") != 0) | (F.col("blob_type") != HEADER_TYPE)).otherwise((F.col("blob_offset") != F.col("before")) | (F.col("blob_type") != DATA_TYPE))
    return b.agg(F.count_if(bad).alias("n_bad"))


def string_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct strings of all string tables."""
    return Extract(spark, extract_of(spark, d, "main")).string_tables().select(F.explode("strings").alias("s")).select(F.decode("s", "UTF-8").alias("string")).distinct()


QUERIES = {f.__name__: f for f in (framing_outcomes, header_fields, seek_rows, for_each_counts, blob_chain, string_values)}

_OUTCOMES = {
    "whole": ("5 elements", "5 elements"), "empty file": ("0 elements", "0 elements"), "header only": ("0 elements", "0 elements"), "1 bytes left over": ("5 elements", "InvalidHeaderSize"),
    "2 bytes left over": ("5 elements", "InvalidHeaderSize"), "3 bytes left over": ("5 elements", "InvalidHeaderSize"), "header cut off": ("BadMessage", "UnexpectedEof"), "body cut off": ("BadMessage", "UnexpectedEof"),
    "header of 65536 bytes": ("HeaderTooBig", "HeaderTooBig"), "header of 65535 bytes": ("5 elements", "5 elements"), "other blob between": ("5 elements", "5 elements"), "negative datasize": ("BadMessage", "BadMessage"),
    "no payload": ("EmptyBlob", "EmptyBlob"), "lz4 payload": ("EmptyBlob", "EmptyBlob"), "payload cut off": ("BadMessage", "BadMessage"), "payload above 32 MiB": ("MessageTooBig", "MessageTooBig"), "no string table": ("BadMessage", "BadMessage"),
}

ORACLES = {
    "framing_outcomes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', '{said}')" for n, both in _OUTCOMES.items() for f, said in zip(FRAMINGS, both)) + ") AS t(fixture, framing, outcome)",
    "header_fields": """SELECT 'a_full.pbf' AS file, -1.5 AS "left", 2.0 AS "right", 1e-9 * 52000000001 AS top, 51.0 AS bottom, 'OsmSchema-V0.6' AS required, 'Sort.Type_then_ID' AS optional, 'writer' AS writing_program, 'survey' AS source,
  CAST(1700000000 AS BIGINT) AS replication_timestamp, CAST(42 AS BIGINT) AS replication_sequence_number, 'https://example.org/replication' AS replication_base_url
 UNION ALL SELECT 'b_bare.pbf', NULL, NULL, NULL, NULL, '', '', NULL, NULL, -1, -1, NULL""",
    "seek_rows": "SELECT 'start' AS how, unnest(range(6, 12)) AS id UNION ALL SELECT 'named', unnest([3, 4, 5, 9, 10, 11]) UNION ALL SELECT 'split', unnest(range(0, 12))",
    "for_each_counts": "SELECT 'node' AS kind, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS id_sum, true AS in_order FROM part UNION ALL SELECT 'way', count(*), CAST(sum(o_orderkey) AS BIGINT), true FROM orders UNION ALL SELECT 'relation', count(*), CAST(sum(n_nationkey) AS BIGINT), true FROM nation",
    "blob_chain": "SELECT CAST(0 AS BIGINT) AS n_bad",
    "string_values": """SELECT '' AS string UNION SELECT unnest(['name', 'brand', 'type', 'status', 'priority', 'region', 'supplier']) UNION SELECT unnest(['building', 'yes']) WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 97 = 0)
 UNION SELECT p_name FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT o_orderstatus FROM orders UNION SELECT o_orderpriority FROM orders
 UNION SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey UNION SELECT n_name FROM nation UNION SELECT r_name FROM nation JOIN region ON r_regionkey = n_regionkey""",
}
