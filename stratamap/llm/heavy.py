"""Most frequent items of a column with hundreds of millions of distinct values, in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamap.session import cut

#: Groups whose sketches a task holds at once; more are handed on early, since sketches add up.
MAX_GROUPS = 64
#: Counters of one group's sketch at most (128 MB); a share that asks for more is refused.
MAX_SLOTS = 1 << 24
#: Candidates that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 500_000


@dataclass(frozen=True)
class Hierarchy:
    """Shape of the sketch: one count-sketch of rows x width per hash prefix length.

    Memory is the sum of rows * width counters per group, whatever the data; where a level has no more prefixes than
    counters, each prefix has its own. A prefix goes on while its estimate reaches ``slack`` times the wanted share.
    """

    prefix_bits: tuple[int, ...] = (8, 16, 24, 32, 40)
    rows: int = 5
    width: int = 8192
    slack: float = 0.5

    @classmethod
    def of(cls, share: float, slack: float = 0.5) -> Hierarchy:
        """The shape for a share: 32 / (slack * share) counters a row, so that the error stays well below slack * share.

        An estimate errs by about |rest| / sqrt(width), where the rest leaves out the width / 8 most frequent prefixes, which
        each are alone in most rows; it is at most total * sqrt(8 / width) / sqrt(width) = 2.8 * total / width, in the
        median of five rows. Shares whose sketch would need more than ``MAX_SLOTS`` counters raise ``ValueError``.
        """
        if not 0 < share <= 1:
            raise ValueError(f"share {share} is not within 0 and 1")
        shape = cls(width=max(4096, 1 << (math.ceil(32 / (slack * share)) - 1).bit_length()), slack=slack)
        if shape.slots > MAX_SLOTS:
            raise ValueError(f"a share of {share} asks for {shape.slots} counters, more than {MAX_SLOTS}; count such rare items exactly")
        return shape

    @property
    def shapes(self) -> list[tuple[int, int]]:
        """Rows and width of each level."""
        return [(1, 1 << b) if 1 << b <= self.width else (self.rows, self.width) for b in self.prefix_bits]

    @property
    def slots(self) -> int:
        return sum(r * w for r, w in self.shapes)

    @property
    def candidates(self) -> int:
        """Prefixes of one level that may survive; by the error bound few more than 1 / (slack * share) do."""
        return self.width


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixer with a seed."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _place(prefix: np.ndarray, level: int, row: int, width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of prefixes in one row of one level; a single row has a counter for each prefix."""
    if rows == 1:
        return prefix.astype(np.int64), np.ones(len(prefix), np.int64)
    h = _mix(prefix, 1 + level * 64 + row)
    return (h % np.uint64(width)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def _add(flat: np.ndarray, h: np.ndarray, weight: np.ndarray, shape: Hierarchy) -> None:
    """Count hashes into a group's sketch."""
    at = 0
    for lv, (bits, (rows, width)) in enumerate(zip(shape.prefix_bits, shape.shapes)):
        p, inv = np.unique(h >> np.uint64(64 - bits), return_inverse=True)
        w = np.zeros(len(p), np.int64)
        np.add.at(w, inv, weight)
        for r in range(rows):
            slot, sign = _place(p, lv, r, width, rows)
            np.add.at(flat, at + slot, sign * w)
            at += width


def _sketch(batches: Iterator[pa.RecordBatch], shape: Hierarchy) -> Iterator[pa.RecordBatch]:
    """Fold a partition into one sketch per group and emit its non-zero counters; slot -1 is the total.

    Beyond ``MAX_GROUPS`` groups the sketches held so far are emitted and begun anew.
    """
    tables: dict[str, np.ndarray] = {}
    totals: dict[str, int] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for name, flat in tables.items():
            slot = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(slot) + 1)), pa.array(np.append(slot, -1)), pa.array(np.append(flat[slot], totals[name]))], ["field_name", "slot", "n"])
        tables.clear()
        totals.clear()

    for b in batches:
        group = b.column("field_name").dictionary_encode()
        codes = group.indices.to_numpy(zero_copy_only=False)
        h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        w = b.column("weight").to_numpy(zero_copy_only=False).astype(np.int64)
        for g, name in enumerate(group.dictionary.to_pylist()):
            if name not in tables and len(tables) >= MAX_GROUPS:
                yield from emptied()
            pick = codes == g
            _add(tables.setdefault(name, np.zeros(shape.slots, np.int64)), h[pick], w[pick], shape)
            totals[name] = totals.get(name, 0) + int(w[pick].sum())
    yield from emptied()


def descend(flat: np.ndarray, total: int, share: float, shape: Hierarchy) -> np.ndarray:
    """Hash prefixes of full length whose estimated count reaches slack * share of the total, level by level."""
    floor = shape.slack * share * total
    heavy = np.zeros(1, np.uint64)
    before = at = 0
    for lv, (bits, (rows, width)) in enumerate(zip(shape.prefix_bits, shape.shapes)):
        step = bits - before
        found = []
        for part in np.array_split(heavy, max(1, len(heavy) >> 12)):
            children = ((part << np.uint64(step))[:, None] | np.arange(1 << step, dtype=np.uint64)[None, :]).ravel()
            guesses = []
            for r in range(rows):
                slot, sign = _place(children, lv, r, width, rows)
                guesses.append(sign * flat[at + r * width + slot])
            found.append(children[np.median(guesses, axis=0) >= floor])
        heavy = np.concatenate(found)
        if len(heavy) > shape.candidates:
            raise RuntimeError(f"{len(heavy)} prefixes of {bits} bits reach {floor} of {total}; the sketch is too narrow for the share")
        at += rows * width
        before = bits
    return heavy


def _candidates(pdf: pd.DataFrame, share: float, shape: Hierarchy) -> pd.DataFrame:
    """The candidates of one group from its merged counters."""
    flat = np.zeros(shape.slots, np.int64)
    own = pdf["slot"].to_numpy() >= 0
    flat[pdf["slot"].to_numpy()[own]] = pdf["n"].to_numpy()[own]
    total = int(pdf["n"].to_numpy()[~own][0])
    heavy = descend(flat, total, share, shape)
    return pd.DataFrame({"field_name": pdf["field_name"].iloc[0], "prefix": heavy.astype(np.int64), "n_group": total})


def heavy_hitters(items: DataFrame, share: float = 0.01, shape: Hierarchy | None = None) -> DataFrame:
    """Items of each group that make up at least ``share`` of it: ``field_name, item, n, n_group``.

    ``items`` has ``field_name string, item string, weight bigint`` with any number of rows per item; null
    groups, items and weights do not count, weights are not negative. The first scan fills signed count-sketches over
    prefixes of a 64-bit hash, wide enough for the share (``Hierarchy.of``) and merged counter by counter; a task per group
    descends its heavy prefixes and gets about 1/(slack*share) candidates. The second scan counts the candidates' items
    exactly, so collisions of hashes only cost work. Any number of groups is counted. Equal counts are all
    reported; no input gives no rows. A sketch may in principle miss an item; README has the recall measured.
    """
    shape = shape or Hierarchy.of(share)
    hashed = items.select("field_name", "item", F.col("weight").cast("bigint").alias("weight"), F.xxhash64("item").alias("h")).dropna()
    counters = hashed.select("field_name", "h", "weight").mapInArrow(lambda it: _sketch(it, shape), "field_name string, slot bigint, n bigint")
    merged = counters.groupBy("field_name", "slot").agg(F.sum("n").alias("n"))
    found = cut(merged.groupBy("field_name").applyInPandas(lambda pdf: _candidates(pdf, share, shape), "field_name string, prefix bigint, n_group bigint"))
    candidates = F.broadcast(found) if found.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else found
    bits = shape.prefix_bits[-1]
    again = hashed.withColumn("prefix", F.shiftrightunsigned("h", 64 - bits)).join(candidates, ["field_name", "prefix"])
    return again.groupBy("field_name", "item").agg(F.sum("weight").alias("n"), F.max("n_group").alias("n_group")).filter(F.col("n") >= F.lit(share) * F.col("n_group"))
