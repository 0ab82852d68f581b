"""Runs, gaps, positions, splits and voyages against plain Python on small, awkward data."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import ordering, runs, splits, voyages

T0 = dt.datetime(2020, 1, 1)


def hours(h, us=0):
    return T0 + dt.timedelta(hours=h, microseconds=us)


def legs(spark, rows):
    return spark.createDataFrame(rows, "ship_id long, client string, utc timestamp, foc_me double")


def reference_runs(rows, gap=6):
    """(ship, client, utc) -> (record_index, record_length) of non-isolated rows."""
    out, index = {}, 0
    ordered = sorted(rows, key=lambda r: r[:3])
    groups = {}
    for row in ordered:
        groups.setdefault(row[:2], []).append(row)
    for key in sorted(groups):
        chain = []
        chains = [chain]
        for row in groups[key]:
            if chain and (row[2] - chain[-1][2]) > dt.timedelta(hours=gap):
                chain = []
                chains.append(chain)
            chain.append(row)
        for chain in chains:
            if len(chain) > 1:
                index += 1
                for row in chain:
                    out[row[:3]] = (index, len(chain))
    return out


def random_rows(seed, hot=False):
    rng = random.Random(seed)
    rows = set()
    for ship in range(1, 6):
        for client in ("a", "b"):
            n = 300 if hot and ship == 1 and client == "a" else rng.choice([1, 2, 30])
            at = 0.0
            for _ in range(n):
                at += rng.choice([0.5, 1, 3, 6, 6.5, 7, 30, 200])
                rows.add((ship, client, T0 + dt.timedelta(hours=at), float(rng.randint(1, 50))))
    return sorted(rows)


@pytest.mark.parametrize("bucket_hours", [1, 5, 24, 24 * 365])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs_do_not_depend_on_buckets(spark, seed, bucket_hours):
    rows = random_rows(seed, hot=True)
    got = runs.continuous_runs(legs(spark, rows), bucket_hours=bucket_hours).collect()
    assert {(r.ship_id, r.client, r.utc): (r.record_index, r.record_length) for r in got} == reference_runs(rows)


def test_gap_edges(spark):
    rows = [(1, "a", hours(0), 1.0), (1, "a", hours(6), 1.0), (1, "a", hours(12, 1), 1.0), (2, "a", hours(0), 1.0)]
    got = {(r.ship_id, r.utc): r for r in runs.point_class(legs(spark, rows), bucket_hours=4).collect()}
    assert [got[1, hours(0)].point_class, got[1, hours(6)].point_class] == ["start", "end"]
    assert got[1, hours(12, 1)].point_class == "isolated"
    assert (got[2, hours(0)].s1, got[2, hours(0)].s2) == (100.0, 100.0)
    assert got[1, hours(6)].s1 == 6.0


@pytest.mark.parametrize("bucket_hours", [1, 24])
def test_run_rules(spark, bucket_hours):
    rows = [(1, "a", hours(i), f) for i, f in enumerate([10.0, 11.0, 12.0, 10.0])]
    rows += [(2, "a", hours(i), f) for i, f in enumerate([10.0, 1.0, 10.0])]  # a low row
    rows += [(3, "a", hours(i), f) for i, f in enumerate([10.0, 10.0, 10.0])]  # no change at all
    rows += [(4, "a", hours(i), f) for i, f in enumerate([0.0, 0.0])]  # zero fuel
    kw = {"bucket_hours": bucket_hours}
    found = runs.continuous_runs(legs(spark, rows), **kw)
    low = runs.low_fuel_flag(found, **kw).where("foc_too_small").collect()
    assert [(r.ship_id, r.foc_me) for r in low] == [(2, 1.0)]
    assert {r.ship_id for r in runs.drop_low_fuel_runs(found, **kw).collect()} == {1, 3, 4}
    step = {(r.ship_id, r.utc): r.foc_diff for r in runs.fuel_step_change(found, **kw).collect()}
    assert step[1, hours(0)] == pytest.approx(10.0)
    assert step[1, hours(3)] == 0.0 and step[4, hours(0)] == 0.0
    v1 = {(r.ship_id, r.utc): r.foc_diff for r in runs.fuel_step_change(found, version=1, **kw).collect()}
    assert v1[1, hours(0)] == pytest.approx(1 / 11)
    assert {r.ship_id for r in runs.run_change_band(found, **kw).collect()} == {1}
    ok = {r.ship_id: r.is_foc_ok for r in runs.run_fuel_ok(found, **kw).collect()}
    assert ok == {1: True, 2: False, 3: True, 4: True}
    bad = found.where("ship_id = 2")
    assert {r.ship_id for r in runs.drop_runs(found, bad).collect()} == {1, 3, 4}


@pytest.mark.parametrize("bucket_hours", [7, 24 * 3650])
def test_positions(spark, bucket_hours):
    rows = random_rows(3, hot=True)
    placed = ordering.with_position(
        legs(spark, rows), ["ship_id"], ["utc", "client"], ordering.time_bucket("utc", bucket_hours)
    ).collect()
    for ship in {r[0] for r in rows}:
        mine = sorted((r.utc, r.client, r.position) for r in placed if r.ship_id == ship)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
        assert {r.group_size for r in placed if r.ship_id == ship} == {len(mine)}


def test_group_offsets_cross_blocks(spark):
    sizes = [(i * 37, (i % 5) + 1) for i in range(100)]
    df = spark.createDataFrame(sizes, "ship_id long, n long")
    got = {r.ship_id: r.off for r in ordering.group_offsets(df, ["ship_id"], "n", "off", block=64).collect()}
    total = 0
    for ship, n in sizes:
        assert got[ship] == total
        total += n


def test_last_fold_split_deals_like_stratified_folds(spark):
    rows = random_rows(4, hot=True)
    got = splits.split_last_fold(legs(spark, rows), ["utc", "client"], bucket_hours=11).collect()
    by_ship = {}
    for r in sorted(got, key=lambda r: (r.ship_id, r.utc, r.client)):
        by_ship.setdefault(r.ship_id, []).append(r.type)

    def last_fold_counts(counts, folds):
        dealt, i = {}, 0
        for ship, n in counts:
            dealt[ship] = sum(1 for j in range(i, i + n) if j % folds == folds - 1)
            i += n
        return dealt

    counts = [(s, len(t)) for s, t in sorted(by_ship.items())]
    tests = last_fold_counts(counts, 5)
    vals = last_fold_counts([(s, n - tests[s]) for s, n in counts], 6)
    for ship, n in counts:
        want = ["train"] * (n - tests[ship] - vals[ship]) + ["val"] * vals[ship] + ["test"] * tests[ship]
        assert by_ship[ship] == want
    shared = splits.shared_keys(splits.split_last_fold(legs(spark, rows), ["utc", "client"]), ["ship_id", "client", "utc"])
    assert tuple(shared.first()) == (0, 0, 0)


def test_time_cut(spark):
    rows = [(1, "a", hours(i), 1.0) for i in range(10)]
    got = splits.split_time_cut(legs(spark, rows), ["utc"], 0.25, bucket_hours=3).orderBy("utc").collect()
    assert [r.type for r in got] == ["train"] * 7 + ["test"] * 3


def test_voyages(spark):
    rng = random.Random(5)
    trips = [(1, hours(0), hours(10)), (1, hours(10), hours(200)), (1, hours(150), hours(160)), (1, hours(0), hours(10))]
    for _ in range(40):
        start = rng.randint(0, 2000)
        trips.append((2, hours(start), hours(start + rng.randint(0, 300))))
    df = spark.createDataFrame(trips, "ship_id long, dep_utc timestamp, arr_utc timestamp")
    numbered = voyages.number_voyages(df, bucket_hours=24)
    listed = sorted(set(trips))
    assert sorted((r.ship_id, r.dep_utc, r.arr_utc, r.rout_id) for r in numbered.collect()) == [
        (*v, i + 1) for i, v in enumerate(listed)
    ]
    asks = [(s, "a", hours(h), float(h)) for s in (1, 2, 3) for h in range(0, 2400, 5)] + [(1, "a", hours(0), -1.0)]
    for bucket, crowded in ((3, 64), (24, 1), (24 * 60, 2)):
        got = voyages.label_voyages(legs(spark, asks), numbered, bucket_hours=bucket, crowded=crowded).collect()
        assert len(got) == len(asks)
        for r in got:
            cover = [i + 1 for i, (s, d, a) in enumerate(listed) if s == r.ship_id and d <= r.utc <= a]
            assert r.rout_id == max(cover, default=0)


def test_alternation(spark):
    good = [(1, hours(0), hours(10)), (1, hours(11), hours(20)), (2, hours(0), hours(300))]
    df = spark.createDataFrame(good, "ship_id long, dep_utc timestamp, arr_utc timestamp")
    assert voyages.alternation_violations(voyages.number_voyages(df)).count() == 0
    bad = df.union(spark.createDataFrame([(2, hours(100), hours(400))], df.schema))
    kinds = [r.variable for r in voyages.alternation_violations(voyages.number_voyages(bad)).collect()]
    assert sorted(kinds) == ["arr_utc", "dep_utc"]
