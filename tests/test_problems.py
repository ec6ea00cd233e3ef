"""The general operators on small hand-made tables: nulls, ties, repeats, emptiness, clashing columns, skew."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratamap.operators import history, near, orphans, wide
from stratamap.operators.current import current_rows, dense_pairs, present_elements, present_ids, zip_pairs
from stratamap.sources.files import Folder

# --- orphans ---------------------------------------------------------------------------------------

KEYS = [None, 1, 2]


def brute_orphans(refs, targets, match):
    out = []
    for r in refs:
        key = r[:2]
        given_ = [i for i, v in enumerate(key) if v is not None]
        if not given_:
            continue
        if len(given_) < 2 and match == "simple":
            continue
        if len(given_) < 2 and match == "full":
            out.append(r)
            continue
        if not any(all(t[i] == key[i] for i in given_) for t in targets):
            out.append(r)
    return sorted(out, key=str)


@pytest.mark.parametrize("match", orphans.MATCHES)
@pytest.mark.parametrize("hot", [None, 1])
def test_orphans_of_composite_keys_with_partial_nulls(spark, match, hot):
    refs = [(a, b, i % 2) for i, (a, b) in enumerate(itertools.product(KEYS, KEYS))] * 2
    for targets in ([(1, 1, 0), (1, None, 0), (None, 2, 0)], []):
        r = spark.createDataFrame(refs, "a int, b int, _n int")
        t = spark.createDataFrame(targets, "a int, b int, other int")
        got = orphans.orphan_references(r, t, ["a", "b"], match, hot_rows=hot)
        assert sorted(map(tuple, got.collect()), key=str) == brute_orphans(refs, targets, match)


def test_orphans_of_nothing_and_unknown_match(spark):
    e = spark.createDataFrame([], "a int, b int")
    assert orphans.orphan_references(e, e, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        orphans.orphan_references(e, e, ["a"], "sometimes")


def test_a_hot_key_is_judged_where_it_lies(spark):
    r = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    t = spark.createDataFrame([(7,)], "k bigint")
    assert orphans.orphan_references(r, t, ["k"], hot_rows=1000).count() == 20000 - 1
    assert orphans.orphan_references(r, spark.createDataFrame([(8,)], "k bigint"), ["k"], hot_rows=1000).filter("k = 7").count() == 10001


def test_orphan_report(spark):
    o = spark.createDataFrame([("t", 1, "2020-01"), ("t", 1, "2020-01"), ("t", 2, None)], "ref_table string, missing_id bigint, month_key string")
    assert sorted(map(str, map(tuple, orphans.orphan_report(o, "ref_table", "month_key").collect()))) == ["('t', '2020-01', 2, 1)", "('t', None, 1, 1)"]


# --- current rows ----------------------------------------------------------------------------------


def test_current_and_present_rows(spark):
    rows = [(1, 1, True), (1, 2, False), (2, None, None), (3, None, True), (3, 1, None), (None, 1, True), (4, 1, False), (4, 1, False)]
    d = spark.createDataFrame(rows, "id bigint, info_version int, info_visible boolean").withColumn("v", F.lit("clash"))
    assert sorted(r.id for r in present_ids(d).collect()) == [2, 3]
    got = {r.id: r.info_visible for r in current_rows(d, ["id"], ["info_visible"]).collect()}
    assert got == {1: False, 2: None, 3: None, 4: False}
    assert present_ids(d.limit(0)).count() == 0


def test_tag_pairs(spark):
    d = spark.createDataFrame([([1, 2, 3], [1], [5, 6]), ([], [], []), (None, None, [1]), ([1, 2], [1, 2], None)], "keys_vals_indices array<int>, key_indices array<int>, val_indices array<int>")
    got = d.select(dense_pairs().alias("d"), zip_pairs().alias("z")).collect()
    assert [[tuple(p) for p in r.d or []] for r in got] == [[(1, 2)], [], [], [(1, 2)]]
    assert [[tuple(p) for p in r.z or []] for r in got] == [[(1, 5)], [], [], []]


def tiny_elements(spark):
    s = spark.createDataFrame([("f", 1, ["", " Lanes\t", "2", "lanes", " +03 ", "lit", "YES", "x"])], "file_path string, blob_offset bigint, strings array<string>")
    n = spark.createDataFrame(
        [("f", 1, 10, [1, 7, 3, 4, 3, 2, 5, 6], 1, None), ("f", 1, 10, [1, 2], None, True), ("f", 1, 11, [99, 2, -1, 3], 1, True), ("f", 2, 12, [1, 2], 1, True), ("f", 1, 13, None, 1, True), ("f", 1, 14, [1, 2], 1, False), (None, None, None, None, None, None)],
        "file_path string, blob_offset bigint, id bigint, keys_vals_indices array<int>, info_version int, info_visible boolean",
    )
    w = spark.createDataFrame([("f", 1, 10, [5], [6, 2], 1, True)], "file_path string, blob_offset bigint, id bigint, key_indices array<int>, val_indices array<int>, info_version int, info_visible boolean")
    return n.withColumn("tags", F.lit(1)).withColumn("strings", F.lit(2)), w, s


def test_wide_cells(spark):
    n, w, s = tiny_elements(spark)
    attrs = wide.discover(spark.createDataFrame([("lanes", "int"), ("lit", "bool"), (None, "int"), ("lit", "bool")], "attr string, attr_type string"))
    e = present_elements(n, w, s, [a for a, _ in attrs])
    assert {(r.elem_kind, r.id): len(r.tags) for r in e.collect()} == {("node", 10): 4, ("node", 11): 0, ("node", 12): 0, ("node", 13): 0, ("way", 10): 1}
    rows = e.select("elem_kind", "id", F.explode("tags").alias("t")).select("elem_kind", "id", F.col("t.key").alias("attr"), "t.value", "t.pos")
    text = wide.pivot_wide(rows, ["elem_kind", "id"], attrs)
    assert sorted(map(tuple, wide.cells(text, ["elem_kind", "id"], attrs).collect())) == [("node", 10, "lanes", "3"), ("node", 10, "lit", "true"), ("way", 10, "lit", "true")]
    t = wide.typed(text, ["elem_kind", "id"], attrs).filter("elem_kind = 'node'").first()
    assert (int(t.lanes), t.lit) == (3, True)


def test_wide_keeps_entities_without_a_listed_attribute(spark):
    rows = spark.createDataFrame([(1, "lanes", "2", 0), (1, "x", "y", 1), (2, "x", "y", 0), (3, None, None, None), (4, "lanes", "no", 0)], "e int, attr string, value string, pos int")
    assert sorted(map(tuple, wide.pivot_wide(rows, ["e"], [("lanes", "int")]).collect())) == [(1, "2"), (2, None), (3, None), (4, None)]


def test_long_numbers_fill_their_cell(spark):
    rows = spark.createDataFrame([(1, "n", "-0" + "9" * 60, 0), (1, "n", "2", 1), (1, "w", "8" * 50 + ",5", 0), (2, "n", "9" * 38, 0)], "e int, attr string, value string, pos int")
    attrs = [("n", "int"), ("w", "decimal")]
    text = wide.pivot_wide(rows, ["e"], attrs)
    assert sorted(map(tuple, text.collect())) == [(1, "-" + "9" * 60, "8" * 50 + ".50"), (2, "9" * 38, None)]
    assert sorted((r.e, r.n and int(r.n), r.w) for r in wide.typed(text, ["e"], attrs).collect()) == [(1, None, None), (2, int("9" * 38), None)]


def test_wide_refuses_bad_lists(spark):
    with pytest.raises(ValueError, match="unknown"):
        wide.discover(spark.createDataFrame([("a", "colour")], "attr string, attr_type string"))
    assert wide.discover(spark.createDataFrame([], "attr string, attr_type string")) == []
    assert wide.pivot_wide(spark.createDataFrame([(1, "a", "b", 0)], "e int, attr string, value string, pos int"), ["e"], []).count() == 1


CASTS = {
    "string": [(" a b\t", "a b"), ("", None), (" \t", None), (None, None), ("x" * 5000, "x" * 5000)],
    "int": [("+007", "7"), ("-0", "0"), ("-12", "-12"), ("1.0", None), ("", None), ("9" * 30, "9" * 30), ("9" * 60, None), ("１", None), ("- 1", None)],
    "decimal": [("12", "12.00"), ("1,5", "1.50"), ("1.25m", "1.25"), ("3 m", "3.00"), ("3  m", None), ("1.234", None), ("-1", None), (".5", None), ("1.", None), ("007.5", "7.50")],
    "bool": [("YES", "true"), ("0", "false"), ("False", "false"), ("ja", None), (" 1 ", "true")],
    "date": [("2020-02-29", "2020-02-29"), ("2021-02-29", None), ("2020/12/01", "2020-12-01"), ("31.12.1999", "1999-12-31"), ("31.04.1999", None), ("2020-1-1", None), ("2020-13-01", None), ("2020-12/01", None)],
}


@pytest.mark.parametrize("kind", sorted(CASTS))
def test_casts(spark, kind):
    d = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASTS[kind])], "i int, v string")
    assert [r.t for r in d.select("i", wide.cast_text(F.col("v"), kind).alias("t")).orderBy("i").collect()] == [w for _, w in CASTS[kind]]


# --- history ---------------------------------------------------------------------------------------


def brute_history(rows):
    last = {}
    for k, v, s, r, p in rows:
        if None in (k, v, s):
            continue
        rank = (r is not None, r or 0, s, p is not None, p if p is not None else 0)
        if (k, v) not in last or rank > last[k, v][0]:
            last[k, v] = (rank, s, p)
    out = []
    for k in {k for k, _ in last}:
        vs = sorted(v for kk, v in last if kk == k)
        for v, nxt in zip(vs, [*vs[1:], None]):
            out.append((k, v, last[k, v][1], last[k, v][2], -1 if nxt is None else last[k, nxt][1]))
    return sorted(out, key=str)


PARTS = [15, 10**6]


@pytest.mark.parametrize("part_rows", PARTS)
def test_history_against_brute_force(spark, part_rows):
    r = np.random.default_rng(1)
    pick = lambda hi: None if r.random() < 0.05 else int(r.integers(hi))
    rows = [(0 if r.random() < 0.4 else pick(20), pick(15), pick(1000), pick(50), pick(3)) for _ in range(800)]
    rows += rows[:50]
    d = spark.createDataFrame(rows, "id bigint, ver int, start bigint, got bigint, p int").withColumn("k", F.lit(1)).repartition(3)
    for period in (None, F.col("got"), F.col("got") % 3):
        got = history.validity_periods(d, "id", "ver", "start", "got", ["p"], period=period, part_rows=part_rows)
        assert sorted((tuple(x) for x in got.select("k", "v", "s", "p", "valid_to").collect()), key=str) == brute_history(rows)
    assert history.validity_periods(d.limit(0), "id", "ver", "start", "got", ["p"], part_rows=part_rows).count() == 0


def test_history_merges_runs_batch_by_batch(spark, monkeypatch, tmp_path):
    """Many runs read two rows at a time, with one version repeated over many batches and runs."""
    rows = sorted((k, v, r, 10 * v + r) for k in range(3) for v in range(9) for r in range(7 if (k, v) != (1, 4) else 90))
    for run in range(4):
        (tmp_path / f"part=0/run={run}").mkdir(parents=True)
        some = rows[run::4]
        pq.write_table(pa.table(dict(zip("kvrs", zip(*some)))), tmp_path / f"part=0/run={run}/a.parquet")
    store = Folder(str(tmp_path))
    steps = list(history.merged(store, 0, 2))
    assert [tuple(x.values()) for t in steps for x in t.to_pylist()] == [max(x for x in rows if x[:2] == (k, v)) for k in range(3) for v in range(9)]
    assert max(t.num_rows for t in steps) <= 8 and list(history.merged(store, 1)) == []


def test_history_of_one_hot_entity_spreads(spark):
    d = spark.range(20000).select(F.lit(5).cast("bigint").alias("id"), F.col("id").alias("ver"), (F.col("id") * 2).alias("start"), F.lit(0).alias("got"))
    got = history.validity_periods(d, "id", "ver", "start", "got", part_rows=1000)
    assert got.select(F.count("*"), F.sum((F.col("valid_to") == F.col("s") + 2).cast("int")), F.count_if(F.col("valid_to") == -1)).first()[:] == (20000, 19999, 1)
    assert got.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()[0] > 10


def test_collapsed_history(spark):
    rows = [(1, 1, 10, "a"), (1, 2, 20, "a"), (1, 3, 30, None), (1, 4, 40, None), (1, 5, 50, "a"), (2, 1, 5, "a")]
    d = spark.createDataFrame(rows, "id bigint, ver bigint, start bigint, p string").withColumn("got", F.lit(1))
    for part_rows in (1, 2, 100):
        got = history.validity_periods(d, "id", "ver", "start", "got", ["p"], collapse=True, part_rows=part_rows).select("k", "s", "p", "valid_to").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, 10, "a", 30), (1, 30, None, 50), (1, 50, "a", -1), (2, 5, "a", -1)], key=str)


@pytest.mark.parametrize("part_rows", PARTS)
def test_runs_go_on_across_parts(spark, part_rows):
    r = np.random.default_rng(2)
    rows = [(k, v, int(r.integers(1000)), None if p == 2 else p) for k in range(6) for v in r.permutation(12000 if k == 0 else 40)[: 300 if k == 0 else 25].tolist() for p in [int(r.integers(3)) if k % 2 else int(v > 9000)]]
    want = []
    for k, v, s, p in sorted(rows, key=lambda x: x[:2]):
        if want and want[-1][0] == k and want[-1][3] == p:
            continue
        if want and want[-1][0] == k:
            want[-1][4] = s
        want.append([k, v, s, p, -1])
    d = spark.createDataFrame(rows, "id bigint, ver bigint, start bigint, p int").withColumn("got", F.lit(1))
    got = history.validity_periods(d, "id", "ver", "start", "got", ["p"], collapse=True, part_rows=part_rows).select("k", "v", "s", "p", "valid_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_a_long_history_of_one_visibility_is_one_run(spark):
    d = spark.range(1, 100001).select(F.lit(5).cast("bigint").alias("id"), F.col("id").alias("ver"), (F.col("id") * 2).alias("start"), F.lit(True).alias("vis"), F.lit(1).alias("got"))
    assert list(map(tuple, history.validity_periods(d, "id", "ver", "start", "got", ["vis"], collapse=True, part_rows=9000).select("k", "v", "s", "vis", "valid_to").collect())) == [(5, 1, 2, True, -1)]


# --- near ------------------------------------------------------------------------------------------


def brute_near(points, metres):
    out = []
    for (i, a, b), (j, c, d) in itertools.combinations(points, 2):
        if i != j and float(near.haversine_m(a * 1e-9, b * 1e-9, c * 1e-9, d * 1e-9)) <= metres:
            out.append((min(i, j), max(i, j)))
    return sorted(out)


def test_near_pairs_against_brute_force(spark):
    r = np.random.default_rng(3)
    pts = [(i, int(50e9 + r.integers(-400_000, 400_000)), int(7e9 + r.integers(-400_000, 400_000))) for i in range(300)]
    pts += [(400 + i, 50_000_000_000, 7_000_000_000) for i in range(20)]
    pts += [(500, 0, 180_000_000_000), (501, 0, -180_000_000_000), (502, 90_000_000_000, 5), (503, 90_000_000_000, 120_000_000_000), (504, 10, -179_999_999_990)]
    bad = [(600, None, 5), (601, 91_000_000_000, 0), (602, 0, 181_000_000_000)]
    d = spark.createDataFrame(pts + bad, "id bigint, p_lat bigint, p_lon bigint").withColumn("leaf", F.lit(1))
    want = brute_near(pts, 20)
    assert len(want) > 250
    for leaf_rows, block in ((10, 2000), (100000, 6)):
        got = near.near_pairs(d, 20.0, leaf_rows=leaf_rows, block=block).collect()
        assert sorted(map(tuple, got)) == want
    places = near.near_positions(d, 20.0).collect()
    assert sum(p.a_n * (p.a_n - 1) // 2 if p[:3] == p[3:] else p.a_n * p.b_n for p in places) == len(want)
    assert near.near_pairs(d.limit(0), 20.0).count() == 0
    assert near.near_pairs(d.filter("id = 600"), 20.0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1), st.floats(-1, 1)), max_size=60), st.floats(0.01, 1))
def test_kd_pairs_are_complete(points, radius):
    xyz = np.array(points).reshape(-1, 3)
    got = sorted((int(i), int(j)) for a, b in near.kd_pairs(xyz, radius) for i, j in zip(a, b))
    want = [(i, j) for i in range(len(xyz)) for j in range(i + 1, len(xyz)) if ((xyz[i] - xyz[j]) ** 2).sum() <= radius * radius]
    assert got == want
    own = np.arange(len(xyz)) % 3 == 0
    some = {(int(i), int(j)) for a, b in near.kd_pairs(xyz, radius, own) for i, j in zip(a, b)}
    assert {(i, j) for i, j in want if own[i] or own[j]} <= some <= set(want)


def test_a_dense_place_is_split_below_the_margin():
    """100,000 positions within 150 m: no leaf owns many, none of the pairs is lost, and they come piece by piece."""
    r = np.random.default_rng(9)
    lat, lon = 50 + r.uniform(0, 150, 100_000) / 111_000, 7 + r.uniform(0, 150, 100_000) / 71_000
    xyz, margin = near.unit_vectors(lat, lon), near.chord(0.5)
    splits = near.fit_splits(xyz[::10], 5, near.chord(20), 4 * 2000 / 10)
    row, leaf, own = near.place(xyz, splits, margin)
    assert np.bincount(leaf[own]).max() < 15_000 and own.sum() == len(xyz) and len(row) < 1.2 * len(xyz)
    found, most = 0, 0
    for x in np.unique(leaf):
        at, mine = row[leaf == x], own[leaf == x]
        for i, j in near.kd_pairs(xyz[at], margin, mine):
            first, most = np.minimum(at[i], at[j]), max(most, len(i))
            found += int(np.where(at[i] == first, mine[i], mine[j]).sum())
    assert found == sum(len(i) for i, _ in near.kd_pairs(xyz, margin)) > 100_000 and most <= 8 * 8 * 8192


def test_placement_covers_the_margin():
    r = np.random.default_rng(5)
    xyz = near.unit_vectors(r.uniform(-90, 90, 500), r.uniform(-180, 180, 500))
    splits = near.fit_splits(xyz, 16, 1e-3)
    assert (splits.dim < 0).sum() == 16
    row, leaf, own = near.place(xyz, splits, 0.05)
    assert own.sum() == 500 and (np.bincount(row) >= 1).all()
    home = dict(zip(row[own], leaf[own]))
    held = set(zip(row.tolist(), leaf.tolist()))
    for i in range(0, 500, 7):
        for j in np.flatnonzero(np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1)) <= 0.05):
            assert (int(j), int(home[i])) in held
    assert math.isclose(near.chord(20.0), 20 / near.EARTH_M, rel_tol=1e-5)


def test_splits_of_skewed_samples_stay_small():
    r = np.random.default_rng(6)
    spread = near.unit_vectors(r.uniform(-90, 90, 2000), r.uniform(-180, 180, 2000))
    chain = near.unit_vectors(np.repeat(45.0, 2000), np.geomspace(1e-4, 100, 2000))
    for xyz in (np.concatenate([spread, np.repeat(spread[:1], 1000, axis=0)]), chain, np.repeat(spread[:1], 50, axis=0), np.empty((0, 3))):
        splits = near.fit_splits(xyz, 500, 1e-9)
        assert len(splits.dim) < 1000
        row, _, own = near.place(xyz, splits, 1e-9)
        assert own.sum() == len(xyz) and len(row) < 1.1 * len(xyz) + 1
