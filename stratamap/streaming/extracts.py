"""A folder of arriving extracts as a stream of elements."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratamap.session import ship_package
from stratamap.sources import blocks, framing, model
from stratamap.sources.datasource import names_of
from stratamap.sources.files import open_file


def _decode_files(batches: Iterator[pa.RecordBatch], columns: Sequence[str], kinds: set[str], strict: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            with open_file(path) as f:
                for head in framing.scan_heads(path, strict):
                    if head.blob_type == framing.DATA_TYPE:
                        yield from blocks.decode_block(framing.payload(framing.read_body(f, head, strict)), path, head.offset, columns, kinds)


def stream_elements(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, kinds: Sequence[str] = model.KINDS, framing_mode: str = "lenient", max_files: int = 64) -> DataFrame:
    """A streaming DataFrame of the elements of every extract that appears in a folder.

    The file stream carries only names and times; each micro-batch decodes its new files in the tasks, block by
    block. A file must appear whole (written under a hidden name and renamed, as the sink does).
    """
    ship_package(spark)
    names, wanted = names_of(",".join(columns) if columns else None, list(model.ELEMENTS)), set(names_of(",".join(kinds), model.KINDS))
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pbf").option("maxFilesPerTrigger", max_files)
        .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path")
    )
    strict = framing_mode == "strict"
    return files.mapInArrow(lambda it: _decode_files(it, names, wanted, strict), model.ddl({c: model.ELEMENTS[c] for c in names}))
