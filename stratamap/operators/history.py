"""History of changing attributes: validity periods from snapshots or updates, by a k-way merge of sorted runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stratamap.session import scratch
from stratamap.sources.files import Folder

#: Sorted runs that one merge holds open; periods beyond share a run.
RUNS = 16
#: Rows a part should hold, parts at most (each task knows all cuts), and sampled rows a part that place the cuts.
PART_ROWS, MAX_PARTS, SAMPLE = 100_000, 20_000, 64
#: Rows read from a run at a time.
BATCH = 16_384


@dataclass(frozen=True)
class Cuts:
    """Borders between parts: part i holds the keys from border i - 1 on, up to border i. Borders are (entity, version)."""

    k: np.ndarray
    v: np.ndarray

    def place(self, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The part of every key."""
        lo, hi = np.searchsorted(self.k, k, "left"), np.searchsorted(self.k, k, "right")
        split = np.flatnonzero(hi > lo)  # entities that a border cuts: the version decides
        if len(split):
            seen = np.unique(self.v)
            code = lambda e, x: e * (len(seen) + 1) + np.searchsorted(seen, x, "right")
            names = np.unique(self.k)
            lo[split] = np.searchsorted(code(np.searchsorted(names, self.k), self.v), code(np.searchsorted(names, k[split]), v[split]), "right")
        return lo


def fit_cuts(keys: DataFrame, rows: int, part_rows: int) -> Cuts:
    """Cuts at quantiles of a bounded sample of ``k, v``; rows are placed exactly whatever the sample looked like."""
    parts = max(1, min(-(-rows // part_rows), MAX_PARTS))
    if parts == 1:
        return Cuts(np.empty(0, np.int64), np.empty(0, np.int64))
    frac = SAMPLE * parts / max(rows, 1)
    seen = (keys if frac >= 1 else keys.sample(frac, 11)).toPandas()
    k, v = seen["k"].to_numpy(np.int64), seen["v"].to_numpy(np.int64)
    order = np.lexsort((v, k))[np.arange(1, parts) * len(k) // parts] if len(k) else np.empty(0, np.int64)
    pairs = np.unique(np.stack([k[order], v[order]]), axis=1)
    return Cuts(pairs[0], pairs[1])


def _winners(rows: pa.Table) -> pa.Table:
    """Rows in the order of entity and version, one for each: the one received last, ties by the greatest content."""
    k, v = rows["k"].to_numpy(), rows["v"].to_numpy()
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
    if not new.all():
        group = np.cumsum(new) - 1
        many = np.flatnonzero(np.bincount(group)[group] > 1)
        names = [c for c in rows.column_names if c not in ("k", "v")]
        some = rows.take(pa.array(order[many])).select(names).append_column("g", pa.array(group[many]))
        ranked = many[pc.sort_indices(some, [(c, "ascending") for c in ("g", *names)], null_placement="at_start").to_numpy()]
        last = ranked[np.append(group[ranked][1:] != group[ranked][:-1], True)]
        keep = np.ones(len(order), bool)
        keep[many] = False
        keep[last] = True
        order = order[keep]
    return rows.take(pa.array(order))


def _prepare(batches: Iterator[pa.RecordBatch], cuts: Cuts) -> Iterator[pa.RecordBatch]:
    """Each row's part. Repeated versions are reduced within a batch, so one delivered a billion times is not shuffled so often."""
    for b in batches:
        for run in np.unique(b.column("run").to_numpy()):
            rows = _winners(pa.Table.from_batches([b.filter(pa.array(b.column("run").to_numpy() == run))]))
            part = pa.array(cuts.place(rows["k"].to_numpy(), rows["v"].to_numpy()).astype(np.int32))
            yield from rows.append_column("part", part).to_batches()


class _Run:
    """A cursor over the rows of one key-sorted run of a part."""

    def __init__(self, store: Folder, paths: Sequence[str], size: int):
        self.batches = (b for p in paths for b in pq.ParquetFile(store.fs.open_input_file(p)).iter_batches(size))
        self.advance()

    def advance(self) -> None:
        self.rows = None
        for b in self.batches:
            if b.num_rows:
                self.rows, self.k, self.v = pa.Table.from_batches([b]), b.column("k").to_numpy(), b.column("v").to_numpy()
                return

    def take(self, k: int, v: int) -> pa.Table | None:
        """The held rows up to the key."""
        a, b = np.searchsorted(self.k, [k, k], "left")[0], np.searchsorted(self.k, k, "right")
        n = int(a + np.searchsorted(self.v[a:b], v, "right"))
        out = self.rows.slice(0, n)
        if n < len(self.k):
            self.rows, self.k, self.v = self.rows.slice(n), self.k[n:], self.v[n:]
        else:
            self.advance()
        return out if n else None


def merged(store: Folder, part: int, size: int = BATCH) -> Iterator[pa.Table]:
    """The versions of a part in the order of entity and version, each once, from all runs at once.

    Of every run one batch is held. The smallest of their last keys bounds what may be passed on: the rows up to it are
    taken from all runs and put in order; the last version waits, since a run may still hold it again.
    """
    files: dict[str, list[str]] = {}
    for path in store.tree(f"part={part}"):
        files.setdefault(path.rsplit("/", 2)[1], []).append(path)
    runs = [r for paths in files.values() if (r := _Run(store, sorted(paths), size)).rows is not None]
    waiting: pa.Table | None = None
    while runs:
        k, v = min((int(r.k[-1]), int(r.v[-1])) for r in runs)
        taken = [t for r in runs if (t := r.take(k, v)) is not None]
        runs = [r for r in runs if r.rows is not None]
        rows = _winners(pa.concat_tables(([waiting] if waiting is not None else []) + taken))
        waiting = rows.slice(rows.num_rows - 1)
        if rows.num_rows > 1:
            yield rows.slice(0, rows.num_rows - 1)
    if waiting is not None:
        yield waiting


def _same_as_before(rows: pa.Table, payload: Sequence[str]) -> np.ndarray:
    """True where a row has the entity and all payload of the row before."""
    same = np.ones(max(rows.num_rows - 1, 0), bool)
    for c in ("k", *payload):
        x = rows[c].combine_chunks()
        codes = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        same &= codes[1:] == codes[:-1]
    return np.append(False, same)


def _last_before(store: Folder, part: int) -> pa.Table | None:
    """The last version before a part: the greatest of its runs' last rows."""
    for p in range(part - 1, -1, -1):
        ends = []
        for path in store.tree(f"part={p}"):
            f = pq.ParquetFile(store.fs.open_input_file(path))
            if f.metadata.num_rows:
                t = f.read_row_group(f.num_row_groups - 1)
                ends.append(t.slice(t.num_rows - 1))
        if ends:
            rows = _winners(pa.concat_tables(ends))
            return rows.slice(rows.num_rows - 1)
    return None


def _lead(batches: Iterator[pa.RecordBatch], folder: str, payload: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Where the run of equal payload ends that is open before a part: ``ends`` there, at ``s`` or (-1) by another entity."""
    store = Folder(folder)
    for b in batches:
        for part in b.column("id").to_pylist():
            before, end = _last_before(store, part), None
            for rows in merged(store, part) if before is not None else ():
                same = _same_as_before(pa.concat_tables([before, rows]), payload)[1:]
                if not same.all():
                    i = int(np.argmin(same))
                    end = rows["s"][i].as_py() if rows["k"][i] == before["k"][0] else -1
                    break
                before = rows.slice(rows.num_rows - 1)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([end is not None]), pa.array([end], pa.int64())], ["part", "ends", "s"])


def _closed(rows: pa.Table, following: tuple[int, int] | None) -> pa.Table:
    """Rows with the start of the next one as their end, if it is of the same entity; ``following`` is (k, s) after the last."""
    k, s = rows["k"].to_numpy(), rows["s"].to_numpy()
    k, s = np.append(k, k[-1] if following is None else following[0]), np.append(s, -1 if following is None else following[1])
    return rows.append_column("valid_to", pa.array(np.where(k[1:] == k[:-1], s[1:], -1)))


def _emit(batches: Iterator[pa.RecordBatch], folder: str, parts: int, payload: Sequence[str], ends: dict[int, int] | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The closed versions of each part; one row waits for its successor, be it in a later part.

    ``ends`` (for collapsed runs) tells for the parts in which the run ends that is open before them, where it does.
    """
    store = Folder(folder)
    for b in batches:
        for part in b.column("id").to_pylist():
            open_ = _last_before(store, part) if ends is not None else None
            held: pa.Table | None = None
            for rows in merged(store, part):
                if ends is not None:
                    both = rows if open_ is None else pa.concat_tables([open_, rows])
                    open_, fresh = rows.slice(rows.num_rows - 1), ~_same_as_before(both, payload)
                    rows = rows.filter(pa.array(fresh[both.num_rows - rows.num_rows :]))
                    if not rows.num_rows:
                        continue
                rows = rows if held is None else pa.concat_tables([held, rows])
                held = rows.slice(rows.num_rows - 1)
                if rows.num_rows > 1:
                    k, s = held["k"][0].as_py(), held["s"][0].as_py()
                    yield from _shaped(_closed(rows.slice(0, rows.num_rows - 1), (k, s)), schema)
            if held is None:
                continue
            if ends is None:
                after = next((t for p in range(part + 1, parts) for t in merged(store, p, 256)), None)
                following = None if after is None else (after["k"][0].as_py(), after["s"][0].as_py())
            else:
                following = next(((held["k"][0].as_py(), ends[p]) for p in range(part + 1, parts) if p in ends), None)
            yield from _shaped(_closed(held, following), schema)


def _shaped(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from rows.select(schema.names).cast(schema).to_batches()


def validity_periods(
    updates: DataFrame, key: str, version: str, start: str, received: str, payload: Sequence[str] = (), collapse: bool = False, period: Column | None = None, rows: int | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """Full history ``k bigint, v bigint, s bigint, payload.., valid_to bigint`` of entities from snapshots or updates in any order.

    Of several rows for one entity and version the one received last counts, ties by the greatest content; a null
    receipt counts as first. Rows without key, version or start do not count. A version is valid from its start to
    the start of the next higher version of its entity, -1 if there is none. With ``collapse`` a version whose payload
    equals the one before it prolongs that one instead. Payload columns hold plain values (numbers, texts, times).

    ``period`` tells the snapshots or deliveries apart (a whole number; periods of one remainder by ``RUNS`` share a run).
    Each becomes a run sorted by entity and version and cut at the same keys as all others, written to the
    shared folder; a task per part merges the part's runs and emits a version when its successor shows up, reading on
    into the next part for its last one. A history of any length passes in the memory of one batch a run, and as
    cuts are (entity, version), one entity with a third of all rows spreads over many tasks.
    """
    spark = updates.sparkSession
    ok = F.col(key).isNotNull() & F.col(version).isNotNull() & F.col(start).isNotNull()
    run = F.coalesce(F.pmod(period.cast("bigint"), F.lit(RUNS)), F.lit(0)).cast("int") if period is not None else F.lit(0)
    feed = updates.filter(ok).select(
        run.alias("run"), F.col(key).cast("bigint").alias("k"), F.col(version).cast("bigint").alias("v"), F.col(received).alias("r"), F.col(start).cast("bigint").alias("s"),
        *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)],
    )
    keys = updates.select(F.col(key).cast("bigint").alias("k"), F.col(version).cast("bigint").alias("v")).dropna()
    cuts = fit_cuts(keys, updates.count() if rows is None else rows, part_rows)
    parts, names = len(cuts.k) + 1, [f"p{i}" for i in range(len(payload))]
    kinds = dict(feed.dtypes)
    typed = [f"{c} {kinds[c]}" for c in ("run", "k", "v", "r", "s", *names)]
    folder = scratch(spark, "history")
    (
        feed.mapInArrow(partial(_prepare, cuts=cuts), ", ".join([*typed, "part int"])).repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "run", "k", "v", "r", "s", *names).write.partitionBy("part", "run").parquet(folder)
    )
    tasks = spark.range(0, parts, 1, parts)
    ends = None
    if collapse and names:
        leads = tasks.mapInArrow(partial(_lead, folder=folder, payload=names), "part bigint, ends boolean, s bigint").filter("ends").collect()
        ends = {r.part: r.s for r in leads}
    columns = [("k", "bigint"), ("v", "bigint"), ("s", "bigint"), *[(c, kinds[c]) for c in names], ("valid_to", "bigint")]
    schema = ", ".join(f"{c} {t}" for c, t in columns)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    out = tasks.mapInArrow(partial(_emit, folder=folder, parts=parts, payload=names, ends=ends, schema=arrow), schema)
    return out.select("k", "v", "s", *[F.col(c).alias(p) for c, p in zip(names, payload)], "valid_to")

