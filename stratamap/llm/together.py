"""Items that appear together: co-occurrence stripes and their significance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamap.session import cut

#: Neighbour entries that one task holds before it hands its stripes on, and pairs that it expands at once.
STRIPE_ENTRIES, PAIRS = 2_000_000, 1_000_000
#: Segments that an item's stripe is cut into by its neighbours, so that no stripe of a frequent item is merged by one task.
SEGMENTS = 8


def _pairs(offsets: np.ndarray, codes: np.ndarray, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ordered pairs (a, b), a not after b in the sorted record, of each record's item codes, at most ``limit`` at once."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    reps = ends - np.arange(len(codes))
    total = np.append(0, np.cumsum(reps))
    for low in range(0, int(total[-1]), limit):
        high = min(low + limit, int(total[-1]))
        i, j = int(np.searchsorted(total, low, "right")) - 1, int(np.searchsorted(total, high, "left"))
        left = np.repeat(np.arange(i, j), np.minimum(total[i + 1 : j + 1], high) - np.maximum(total[i:j], low))
        right = left + np.arange(low, high) - total[left]
        yield codes[left], codes[right]


def _batch(names: list[str | None], a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stripes ``item, near, n`` of sorted item codes ``a``, their neighbours and counts."""
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
    at = pa.array(np.append(start, len(a)).astype(np.int32))
    label = pa.array(names, pa.string())
    take = lambda x: label.take(pa.array(x))
    return pa.RecordBatch.from_arrays([take(a[start]), pa.ListArray.from_arrays(at, take(b)), pa.ListArray.from_arrays(at, pa.array(n))], ["item", "near", "n"])


def _stripes(batches: Iterator[pa.RecordBatch], limit: int = STRIPE_ENTRIES, pairs: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """Per item an associative array neighbour -> count, the item's own count included; flushed at the limit.

    The stripe of the null item counts the records. A record of any size is expanded a bounded number of pairs at a time.
    """
    book: dict[str, int] = {}
    names: list[str | None] = []
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    records = 0
    for batch in batches:
        lists = batch.column("items")
        records += len(lists)
        flat = lists.flatten().dictionary_encode()
        for v in flat.dictionary.to_pylist():
            if v not in book:
                book[v] = len(names)
                names.append(v)
        codes = np.array([book[v] for v in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _pairs(np.append(0, np.cumsum(size)), codes, pairs):
            keys, at = np.unique(np.append(keys, (a << 32) | b), return_inverse=True)
            counts = np.bincount(at, np.append(counts, np.ones(len(a), np.int64)), len(keys)).astype(np.int64)
            if len(keys) > limit:
                yield _batch(names, keys >> 32, keys & 0xFFFFFFFF, counts)
                keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(keys):
            book, names = {}, []
    yield _batch([*names, None], np.append(keys >> 32, len(names)), np.append(keys & 0xFFFFFFFF, len(names)), np.append(counts, records))


def _merge(batches: Iterator[pa.RecordBatch], limit: int = STRIPE_ENTRIES) -> Iterator[pa.RecordBatch]:
    """One stripe per item and segment of stripes sorted by them: associative arrays are added up, key by key."""
    key, near, n = None, [], []

    def added() -> tuple[pa.Array, np.ndarray]:
        names = pa.concat_arrays(near).dictionary_encode(null_encoding="encode")
        return names.dictionary, np.bincount(names.indices.to_numpy(), np.concatenate(n), len(names.dictionary)).astype(np.int64)

    def stripe() -> pa.RecordBatch:
        names, total = added()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], ["item", "near", "n"])

    held = 0
    for b in batches:
        items, segments = b.column("item").to_pylist(), b.column("segment").to_pylist()
        for i, now in enumerate(zip(items, segments)):
            if now != key and near:
                yield stripe()
                near, n, held = [], [], 0
            key = now
            near.append(b.column("near")[i].values)
            n.append(b.column("n")[i].values.to_numpy())
            held += len(near[-1])
            if held > limit:
                names, total = added()
                near, n, held = [names], [total], 0
    if near:
        yield stripe()


def log_likelihood_ratio(n_ab, n_a, n_b, n):
    """Dunning's G2 of the 2x2 table of two items, as a Column."""

    def part(k, row, col):
        return F.when(k > 0, k * F.log(k.cast("double") * n / (row.cast("double") * col.cast("double")))).otherwise(0.0)

    return 2 * (part(n_ab, n_a, n_b) + part(n_a - n_ab, n_a, n - n_b) + part(n_b - n_ab, n - n_a, n_b) + part(n - n_a - n_b + n_ab, n - n_a, n - n_b))


def co_occurrence(records: DataFrame) -> DataFrame:
    """``key_a, key_b, n_ab, n_a, n_b, n, lift, llr`` for every pair ``key_a < key_b`` that stands together.

    ``records`` has ``items array<string>``; an item counts once per record, nulls do not count, a record
    without any item does not count as one. Each task merges its records into stripes (flushed at a fixed
    number of entries), cuts them into segments by a hash of the neighbour and sends them to the task of their item and segment,
    which adds them up as arrays: an item in a third of all records sends one stripe per task, to as many
    reducers as there are segments. The merged stripes are written to the shared checkpoint folder, as they are used three times.
    """
    clean = records.select(F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).filter(F.size("items") > 0)
    stripes = clean.mapInArrow(_stripes, "item string, near array<string>, n array<bigint>")
    entries = F.arrays_zip("near", "n")
    segment = lambda i: F.filter(entries, lambda e: F.pmod(F.hash(e["near"]), F.lit(SEGMENTS)) == i)
    parts = F.array(*[F.struct(F.lit(i).alias("segment"), segment(i).alias("e")) for i in range(SEGMENTS)])
    cutup = stripes.select("item", F.explode(parts).alias("p")).filter(F.size("p.e") > 0).select("item", "p.segment", F.col("p.e.near").alias("near"), F.col("p.e.n").alias("n"))
    merged = cutup.repartition("item", "segment").sortWithinPartitions("item", "segment").mapInArrow(_merge, "item string, near array<string>, n array<bigint>")
    kept = cut(merged).select("item", F.explode(F.arrays_zip("near", "n")).alias("e")).select("item", F.col("e.near").alias("other"), F.col("e.n").alias("n"))
    row = kept.filter("item is null").first()
    total = F.lit(int(row["n"]) if row else 0).cast("bigint")
    pairs = kept.filter("item < other").select(F.col("item").alias("key_a"), F.col("other").alias("key_b"), F.col("n").alias("n_ab"))
    single = kept.filter("item = other")
    pairs = pairs.join(single.select(F.col("item").alias("key_a"), F.col("n").alias("n_a")), "key_a").join(single.select(F.col("item").alias("key_b"), F.col("n").alias("n_b")), "key_b")
    return pairs.select(
        "key_a", "key_b", "n_ab", "n_a", "n_b", total.alias("n"),
        (F.col("n_ab").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"), log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), total).alias("llr"),
    )
