"""Framing of an extract: length, header, body; and the payload of a blob."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from stratamap.sources.errors import BadMessage, EmptyBlob, ExtractError, HeaderTooBig, InvalidHeaderSize, MessageTooBig, UnexpectedEof
from stratamap.sources.files import open_file
from stratamap.sources.wire import BYTES, VARINT, fields, int32

#: Fixed values of the format: limits in bytes and the two blob types that are decoded.
HEADER_LIMIT, MESSAGE_LIMIT = 1 << 16, 1 << 25
HEADER_TYPE, DATA_TYPE = "OSMHeader", "OSMData"
FRAMINGS = ("lenient", "strict")


@dataclass(frozen=True)
class BlobHead:
    """A blob's place, type and sizes. ``offset`` is where its length prefix starts."""

    offset: int
    blob_type: str
    header_size: int
    datasize: int

    @property
    def body(self) -> int:
        return self.offset + 4 + self.header_size


def parse_head(buf: bytes, offset: int) -> BlobHead:
    kind = size = None
    for number, wire, a, b in fields(buf, where="blob header"):
        if number == 1 and wire == BYTES:
            try:
                kind = buf[a:b].decode()
            except UnicodeDecodeError as e:
                raise BadMessage("blob header", "the type is not UTF-8") from e
        elif number == 3 and wire == VARINT:
            size = int32(a)
    if kind is None or size is None:
        raise BadMessage("blob header", "type or datasize is missing")
    if size < 0:
        raise BadMessage("blob header", f"negative datasize {size}")
    return BlobHead(offset, kind, len(buf), size)


def read_head(f: BinaryIO, strict: bool) -> BlobHead | None:
    """The header at the file's position, None at the end.

    One to three bytes before the end are ignored unless ``strict``; a header that is cut off is handed to the
    parser as it is (lenient) or refused at once (strict).
    """
    offset = f.tell()
    prefix = f.read(4)
    if len(prefix) < 4:
        if strict and prefix:
            raise InvalidHeaderSize(f"InvalidHeaderSize: {len(prefix)} bytes left at {offset}")
        return None
    (size,) = struct.unpack(">I", prefix)
    if size >= HEADER_LIMIT:
        raise HeaderTooBig(size)
    buf = f.read(size)
    if strict and len(buf) < size:
        raise UnexpectedEof(f"UnexpectedEof: header at {offset} is cut off")
    head = parse_head(buf, offset)
    return BlobHead(offset, head.blob_type, size, head.datasize)


def scan_heads(path: str, strict: bool = False, start: int = 0) -> Iterator[BlobHead]:
    """All headers from ``start`` on, skipping over bodies. A cut-off last body goes unnoticed here."""
    with open_file(path) as f:
        end = f.seek(0, 2)
        if start > end:
            raise UnexpectedEof(f"UnexpectedEof: offset {start} lies beyond the {end} bytes of {path}")
        f.seek(start)
        while (head := read_head(f, strict)) is not None:
            yield head
            f.seek(head.body + head.datasize)
            if f.tell() > end:
                return


#: Headers in a row that must fit before a place counts as the begin of a blob, and bytes searched at a time.
CHAIN, WINDOW = 64, 1 << 20


def _chained(f: BinaryIO, at: int, end: int) -> bool:
    """Whether ``CHAIN`` blobs follow each other from a place on, or as many as there are up to the end."""
    for _ in range(CHAIN):
        f.seek(at)
        try:
            head = read_head(f, True)
        except ExtractError:
            return False
        if head is None:
            return True
        at = head.body + head.datasize
        if at >= end:
            return at == end
    return True


def sync(f: BinaryIO, start: int, end: int) -> int:
    """Where the first blob begins that is found at ``start`` or behind; ``end`` if there is none.

    Lengths of headers are small, and a header begins with its type: places that look so are tried in turn. A blob whose
    header looks otherwise is passed over, so whoever reads up to here must go on from the blob before.
    """
    if start <= 0:
        return 0
    for low in range(start, end, WINDOW):
        f.seek(low)
        buf = np.frombuffer(f.read(WINDOW + 4), np.uint8)
        if len(buf) < 5:
            break
        for at in np.flatnonzero((buf[:-4] == 0) & (buf[1:-3] == 0) & (buf[4:] == 10)).tolist():
            if _chained(f, low + at, end):
                return low + at
    return end


def range_heads(path: str, strict: bool, low: int, high: int | None, start: int = 0) -> Iterator[BlobHead]:
    """Headers of the blobs of one range of bytes: from the first blob found in it to the first one found behind it.

    Ranges that touch share out all blobs between them: each goes on to exactly the place where the next one begins.
    """
    with open_file(path) as f:
        end = f.seek(0, 2)
        if low <= start:
            low = start
            if start > end:
                raise UnexpectedEof(f"UnexpectedEof: offset {start} lies beyond the {end} bytes of {path}")
        else:
            low = sync(f, low, end)
        stop = end + 1 if high is None or high >= end else sync(f, max(high, start), end) if high > start else start
        stop = end + 1 if stop == end else stop
        f.seek(low)
        while low < stop and low < end + 1 and (head := read_head(f, strict)) is not None:
            yield head
            low = head.body + head.datasize
            if low > stop and stop <= end:
                raise BadMessage("framing", f"the blob at {head.offset} ends at {low}, beyond the blob found at {stop}")
            f.seek(low)
            if low > end:
                return


def head_at(f: BinaryIO, offset: int, strict: bool) -> BlobHead:
    f.seek(offset)
    head = read_head(f, strict)
    if head is None:
        raise UnexpectedEof(f"UnexpectedEof: no blob at {offset}")
    return head


def read_body(f: BinaryIO, head: BlobHead, strict: bool) -> bytes:
    f.seek(head.body)
    body = f.read(head.datasize)
    if strict and len(body) < head.datasize:
        raise UnexpectedEof(f"UnexpectedEof: body of the blob at {head.offset} is cut off")
    return body


def parse_body(body: bytes) -> tuple[int, int, int]:
    """(field, start, end) of the payload; the last one counts, field 0 if there is none."""
    found = (0, 0, 0)
    for number, wire, a, b in fields(body, where="blob"):
        if number in (1, 3, 4, 5, 6, 7) and wire == BYTES:
            found = (number, a, b)
    return found


def payload(body: bytes) -> bytes:
    """The message inside a blob. Other compressions than zlib count as no payload."""
    field, a, b = parse_body(body)
    if field == 1:
        if b - a >= MESSAGE_LIMIT:
            raise MessageTooBig(b - a)
        return body[a:b]
    if field == 3:
        z = zlib.decompressobj()
        try:
            out = z.decompress(body[a:b], MESSAGE_LIMIT)
        except zlib.error as e:
            raise BadMessage("zlib payload", str(e)) from e
        if not z.eof:
            if len(out) >= MESSAGE_LIMIT:
                raise MessageTooBig(len(out))
            raise BadMessage("zlib payload", "the stream is cut off")
        return out
    raise EmptyBlob()
