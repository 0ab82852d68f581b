"""The paths taken by hot keys give the same results as the ordinary ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import clean, evaluate, outliers
from wakeline.operators.quantiles import grouped_quantiles
from wakeline.operators.sized import attach


def test_attach_paths_agree(spark):
    rows = spark.createDataFrame(
        [(i % 7 if i % 3 else None, i) for i in range(500)] + [(99, i) for i in range(300)], "k long, v long"
    )
    table = spark.createDataFrame([(k, k * 10) for k in range(5)] + [(None, -1), (99, 990)], "k long, w long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = sorted(map(str, attach(rows, table, ["k"], how).collect()))
        shuffled = sorted(map(str, attach(rows, table, ["k"], how, bound=0).collect()))
        heavy = sorted(map(str, attach(rows, table, ["k"], how, bound=0, heavy_rows=100).collect()))
        assert small == shuffled == heavy
    assert len(attach(rows, table, ["k"], "inner").collect()) > 400


def test_keep_first_and_rejects_partition_the_rows(spark):
    rng = random.Random(1)
    data = [(rng.randint(1, 3), rng.randint(1, 3), float(rng.randint(1, 3)), rng.choice(["x", None])) for _ in range(200)]
    data += [(1, 1, 9.0, "x")] * 25_000  # one row copied many times: more than one chunk
    df = spark.createDataFrame(data, "ship_id long, utc long, foc double, note string")
    first = clean.keep_first(df, ["ship_id", "utc"])
    rejected = clean.duplicate_rows(df, ["ship_id", "utc"])
    keys = {d[:2] for d in data}
    assert first.count() == len(keys)
    assert rejected.count() == len(data) - len(keys)
    together = sorted(map(str, first.union(rejected).collect()))
    assert together == sorted(map(str, df.collect()))
    low = {(r.ship_id, r.utc): r.foc for r in first.collect()}
    for key in keys:
        assert low[key] == min(d[2] for d in data if d[:2] == key)


def test_rank_decides_first(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 9.0, 0)], "ship_id long, foc double, source_rank int")
    assert clean.keep_first(df, ["ship_id"], ["source_rank"]).first().foc == 9.0


@pytest.mark.parametrize("shape", ["spread", "ties", "spike"])
def test_bracketed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(3)
    n = 4000
    hot = {
        "spread": rng.normal(size=n),
        "ties": rng.integers(0, 5, size=n).astype(float),
        "spike": np.concatenate([np.full(n // 3, 2.5), rng.normal(size=n - n // 3)]),
    }[shape]
    cold = rng.normal(size=40)
    data = [(1, float(v)) for v in hot] + [(2, float(v)) for v in cold] + [(1, None)]
    df = spark.createDataFrame(data, "ship_id long, v double")
    probs = [0.0, 0.03, 0.5, 0.97, 1.0]
    got = {r.ship_id: r.quantiles for r in grouped_quantiles(df, ["ship_id"], "v", probs, hot_rows=1000, accuracy=200).collect()}
    assert got[1] == pytest.approx(np.quantile(hot, probs).tolist(), abs=1e-12)
    assert got[2] == pytest.approx(np.quantile(cold, probs).tolist(), abs=1e-12)
    whole = grouped_quantiles(df, [], "v", probs, hot_rows=1000, accuracy=200).first().quantiles
    assert whole == pytest.approx(np.quantile(np.concatenate([hot, cold]), probs).tolist(), abs=1e-12)


def brute(points, k):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    return np.sort(d, axis=1)[:, k]


@pytest.mark.parametrize("block_rows", [50, 20_000])
def test_knn_1d(spark, block_rows):
    rng = np.random.default_rng(5)
    ships = {
        1: np.concatenate([rng.normal(size=300), np.full(150, 0.5)]),
        2: rng.integers(0, 9, size=120).astype(float),
        3: rng.normal(size=5),  # too small: k = 0
    }
    data = [(s, float(v)) for s, x in ships.items() for v in x] + [(1, None)]
    df = spark.createDataFrame(data, "ship_id long, v double")
    got = outliers.knn_score_1d(df, "v", block_rows=block_rows, hot_rows=100).collect()
    assert len(got) == len(data)
    for ship, x in ships.items():
        k = min(100, int(len(x) * 0.1))
        mine = sorted((r.v, r.outlier_score) for r in got if r.ship_id == ship and r.v is not None)
        if k == 0:
            assert all(s is None for _, s in mine)
            continue
        want = sorted(zip(x.tolist(), brute(x[:, None], k).tolist()))
        assert np.allclose(np.array(mine), np.array(want), atol=1e-12)
    assert [r.outlier_score for r in got if r.v is None] == [None]


@pytest.mark.parametrize("cell_points", [40, 4096])
def test_knn_cells(spark, cell_points):
    rng = np.random.default_rng(7)
    clustered = np.concatenate(
        [
            rng.normal(size=(300, 3)),
            rng.normal(size=(60, 3)) * 0.01 + 5,
            np.array([[100.0, 0, 0], [0, -80.0, 3]]),  # far away
            np.tile([[1.0, 2.0, 3.0]], (200, 1)),  # many copies
        ]
    )
    flat = np.column_stack([np.full(150, 2.0), rng.integers(0, 40, 150), np.full(150, 7.0)]).astype(float)
    ships = {1: clustered, 2: flat, 3: rng.normal(size=(30, 3))}
    data = [(s, *map(float, p)) for s, x in ships.items() for p in x]
    df = spark.createDataFrame(data, "ship_id long, a double, b double, c double")
    got = outliers.knn_score(df, ["a", "b", "c"], cell_points=cell_points).collect()
    assert len(got) == len(data)
    for ship, x in ships.items():
        k = min(100, int(len(x) * 0.1))
        want = sorted((*p, s) for p, s in zip(x.tolist(), brute(x, k).tolist()))
        mine = sorted((r.a, r.b, r.c, r.outlier_score) for r in got if r.ship_id == ship)
        assert np.allclose(np.array(mine), np.array(want), atol=1e-9)


@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_percent_rank_table(spark, hot_rows):
    rng = random.Random(2)
    data = [(rng.choice(["x", "y"]), rng.choice([0.5, rng.random(), 1000.0])) for _ in range(400)]
    df = spark.createDataFrame(data, "type string, v double")
    got = {(r.type, r.v): (r.n_rows, r.pct_rank) for r in evaluate.percent_rank_table(df, ["type"], "v", hot_rows).collect()}
    for kind in ("x", "y"):
        mine = [v for t, v in data if t == kind]
        for v in set(mine):
            n, rank = got[kind, v]
            assert n == mine.count(v)
            assert math.isclose(rank, sum(m < v for m in mine) / (len(mine) - 1))


def test_outlier_label(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(11)], "ship_id long, outlier_score double")
    flagged = outliers.outlier_label(df).where("outlier_label = 1").collect()
    assert [r.outlier_score for r in flagged] == [10.0]  # the 0.9 quantile is 9, not itself above


def test_pca_outlier_per_ship(spark):
    """Distances to the unit components of the ship's own correlation matrix, over their shares of variance."""
    rng = np.random.default_rng(9)
    mix = np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    parts = {1: rng.normal(size=(80, 3)) @ mix, 2: rng.normal(size=(50, 3)) @ mix.T, 3: np.array([[1.0, i, -i] for i in range(9)])}
    rows = [(s, i, *map(float, p)) for s, x in parts.items() for i, p in enumerate(x)]
    rows += [(1, 900, None, 1.0, 1.0), (4, 0, 1.0, 1.0, 1.0), (None, 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "ship_id long, i long, a double, b double, c double")
    got = {(r.ship_id, r.i): r.outlier_score for r in outliers.pca_outlier(df, ["a", "b", "c"]).collect()}
    assert len(got) == len(rows) and got[1, 900] is None and got[4, 0] is None
    for ship, x in parts.items():
        if ship == 3:  # one column is constant, the others are one: a single component
            assert all(got[3, i] is None for i in range(9))
            continue
        z = (x - x.mean(0)) / x.std(0)
        _, w, vt = np.linalg.svd(z, full_matrices=False)
        share = w**2 / (w**2).sum()
        vt = vt * np.sign(np.take_along_axis(vt, np.abs(vt).argmax(1)[:, None], 1))
        want = sum(np.sqrt(((z - vt[k]) ** 2).sum(1)) / share[k] for k in range(2))
        assert [got[ship, i] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-6)


def test_keep_first_sorts_after_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("ship_id"), (F.col("id") % 3).alias("utc"), F.rand(1).alias("foc"))
    plan = clean.keep_first(df, ["ship_id", "utc"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "Sort" not in below and plan.count("Exchange") == 1


def test_single_filter_is_the_joint_rule_on_all_rows(spark):
    """Every score counts all rows, not those an earlier limit has left."""
    rng = np.random.default_rng(8)
    data = [(s, float(a), float(b) if i % 9 else None) for s in (1, 2) for i, (a, b) in enumerate(rng.integers(0, 60, (80, 2)))]
    df = spark.createDataFrame(data, "ship_id long, a double, b double")
    got = outliers.single_filter(df, {"a": 4.0, "b": 5.0}).collect()
    scored = outliers.knn_score_1d(outliers.knn_score_1d(df, "a", out="sa"), "b", out="sb")
    want = scored.where("sa < 4.0 AND sb < 5.0").select("ship_id", "a", "b").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and 0 < len(got) < len(data)
    joins = outliers.single_filter(df, {"a": 4.0, "b": 5.0})._jdf.queryExecution().executedPlan().toString().count("Join ")
    assert joins <= 2
