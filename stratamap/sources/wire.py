"""Protocol buffer wire format, whole arrays of packed numbers at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from stratamap.sources.errors import BadMessage

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def fields(buf: bytes, start: int = 0, end: int | None = None, where: str = "message") -> Iterator[tuple[int, int, int, int]]:
    """(field number, wire type, a, b) of each field: a is the value of a varint, else buf[a:b] is the payload."""
    i, end = start, len(buf) if end is None else end
    while i < end:
        tag = shift = 0
        while True:
            if i >= end or shift > 63:
                raise BadMessage(where, "a field tag is cut off")
            c = buf[i]
            i += 1
            tag |= (c & 127) << shift
            if c < 128:
                break
            shift += 7
        number, kind = tag >> 3, tag & 7
        if not number:
            raise BadMessage(where, "field number 0")
        if kind == VARINT or kind == BYTES:
            v = shift = 0
            while True:
                if i >= end or shift > 63:
                    raise BadMessage(where, "a varint is cut off")
                c = buf[i]
                i += 1
                v |= (c & 127) << shift
                if c < 128:
                    break
                shift += 7
            if kind == VARINT:
                yield number, kind, v & 0xFFFFFFFFFFFFFFFF, 0
            else:
                if i + v > end:
                    raise BadMessage(where, "a field is longer than its message")
                yield number, kind, i, i + v
                i += v
        elif kind in (FIXED32, FIXED64):
            n = 4 if kind == FIXED32 else 8
            if i + n > end:
                raise BadMessage(where, "a fixed field is cut off")
            yield number, kind, i, i + n
            i += n
        else:
            raise BadMessage(where, f"wire type {kind}")


def signed(v: int) -> int:
    """A 64-bit varint as int64."""
    return v - (1 << 64) if v >> 63 else v


def int32(v: int) -> int:
    """A varint as int32: the low 32 bits."""
    v &= 0xFFFFFFFF
    return v - (1 << 32) if v >> 31 else v


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def varints(buf: bytes, where: str = "packed field") -> np.ndarray:
    """All varints of a packed field as uint64."""
    b = np.frombuffer(buf, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    stop = np.flatnonzero(b < 128)
    if not len(stop) or stop[-1] != len(b) - 1:
        raise BadMessage(where, "a packed varint is cut off")
    start = np.append(0, stop[:-1] + 1)
    size = stop - start + 1
    longest = int(size.max())
    if longest > 10:
        raise BadMessage(where, "a packed varint of more than 10 bytes")
    out = np.zeros(len(stop), np.uint64)
    for k in range(longest):
        at = np.flatnonzero(size > k) if k else slice(None)
        out[at] |= (b[start[at] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out


def as_signed(v: np.ndarray) -> np.ndarray:
    return v.view(np.int64)


def as_int32(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint32).view(np.int32).astype(np.int64)


def zigzag_decoded(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def running(deltas: np.ndarray, where: str) -> np.ndarray:
    """Running sum of deltas; leaving the 64-bit range is an error."""
    if len(deltas) and np.abs(deltas.astype(float)).sum() > 9.2e18 and np.abs(np.cumsum(deltas.astype(float))).max() > 9.2e18:
        raise BadMessage(where, "delta coded numbers leave the 64-bit range")
    return np.cumsum(deltas)


def running_by(deltas: np.ndarray, size: np.ndarray, where: str) -> np.ndarray:
    """Running sums that start anew in each list of the given sizes."""
    total = running(deltas, where)
    start = np.cumsum(size) - size
    before = np.append(0, total)[start]
    return total - np.repeat(before, size)


# --- writing ---------------------------------------------------------------------------------------


def put_varint(v: int) -> bytes:
    v &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def zigzag(v: int) -> int:
    return (v << 1) ^ (v >> 63)


def put_number(field: int, v: int) -> bytes:
    return put_varint(field << 3) + put_varint(v)


def put_bytes(field: int, v: bytes) -> bytes:
    return put_varint(field << 3 | BYTES) + put_varint(len(v)) + v


def put_packed(field: int, values, zig: bool = False) -> bytes:
    """A packed field of integers; nothing for an empty list."""
    v = np.asarray(values, np.int64)
    if not len(v):
        return b""
    u = ((v << 1) ^ (v >> 63)).view(np.uint64) if zig else v.view(np.uint64)
    size = np.ones(len(u), np.int64)
    for k in range(1, 10):
        size += u >> np.uint64(7 * k) > 0
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max())):
        at = np.flatnonzero(size > k)
        part = (u[at] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[at] + k] = part.astype(np.uint8) | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return put_bytes(field, out.tobytes())
