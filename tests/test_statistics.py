"""Densities, normal quantiles and exact splits against plain numpy."""

import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import normal
from wakeline.operators import density, evaluate, splits


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02425, 0.1, 0.5, 0.7, 0.97575, 0.99999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0, None]], "p double")
    got = {r.p: (r.q, r.s) for r in df.select("p", normal.quantile(F.col("p")).alias("q"), F.expr(normal.quantile_sql("p")).alias("s")).collect()}
    for p in ps:
        assert got[p][0] == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)
        assert got[p][0] == pytest.approx(got[p][1], rel=1e-12, abs=1e-15)
    assert all(got[p][0] is None for p in (0.0, 1.0, -1.0, None))


def test_normal_quantile_table(spark):
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(5, 2, 300).round(1).tolist(), "b": [1.0] * 4, None: [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in x.items() for v in vs] + [("a", None)], "g string, x double")
    for hot in (50, 10**6):
        got = {(r.g, r.x): r for r in evaluate.normal_quantile_table(df, ["g"], "x", hot).collect()}
        assert set(got) == {(g, v) for g, vs in x.items() for v in vs}
        for g, vs in x.items():
            mean, dev = np.mean(vs), np.std(vs)
            for v in set(vs):
                below, n = sum(u < v for u in vs), vs.count(v)
                r = got[g, v]
                assert r.n_rows == n
                assert r.normal_low == pytest.approx(NormalDist().inv_cdf((below + 1) / (len(vs) + 1)), abs=1e-8)
                assert r.normal_high == pytest.approx(NormalDist().inv_cdf((below + n) / (len(vs) + 1)), abs=1e-8)
                assert r.standardised == (None if dev == 0 else pytest.approx((v - mean) / dev))


def test_density_near_the_direct_sum(spark):
    rng = np.random.default_rng(8)
    x = {"a": rng.normal(size=500), "b": np.concatenate([rng.normal(-3, 1, 200), rng.normal(4, 0.5, 100)])}
    rows = [(g, float(v)) for g, vs in x.items() for v in vs] + [("c", 1.0), ("c", 1.0), ("d", 2.0), ("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = density.densities(df, ["g"], ["x"], grid=200).collect()
    assert {r.g for r in got} == {"a", "b"} and len(got) == 400
    for g, vs in x.items():
        h = vs.std(ddof=1) * len(vs) ** -0.2
        own = sorted((r for r in got if r.g == g), key=lambda r: r.i_x)
        at = np.array([r.x for r in own])
        assert at[0] == pytest.approx(vs.min() - 3 * h) and at[-1] == pytest.approx(vs.max() + 3 * h)
        direct = np.exp(-0.5 * ((at[:, None] - vs[None]) / h) ** 2).mean(1) / (h * math.sqrt(2 * math.pi))
        made = np.array([r.density for r in own])
        assert np.abs(made - direct).max() < 0.01 * direct.max()
        assert made.sum() * (at[1] - at[0]) == pytest.approx(1, abs=0.01)


def test_density_of_two_columns(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(400, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    df = spark.createDataFrame([("g", *map(float, v)) for v in p] + [("flat", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    got = density.densities(df, ["g"], ["x", "y"], grid=60).collect()
    assert {r.g for r in got} == {"g"} and len(got) == 3600
    h = p.std(0, ddof=1) * len(p) ** (-1 / 6)
    at = np.array([(r.x, r.y) for r in got])
    z = (at[:, None, :] - p[None]) / h
    direct = np.exp(-0.5 * (z**2).sum(2)).mean(1) / (2 * math.pi * h.prod())
    assert np.abs(np.array([r.density for r in got]) - direct).max() < 0.03 * direct.max()


def test_split_exact(spark):
    rows = [(i, ("a", "b", None)[i % 3 if i < 300 else 0]) for i in range(400)]
    rows += [(7000, "same")] * 10 + [(8000, "one")]
    df = spark.createDataFrame(rows, "id long, s string")
    for bits in (16, 8):
        typed = splits.split_exact(df, ["id"], 0.25, ["s"], seed=3, bits=bits).collect()
        assert sorted(str((r.id, r.s)) for r in typed) == sorted(map(str, rows))
        for s, n in Counter(s for _, s in rows).items():
            assert sum(r.s == s and r.type == "test" for r in typed) == math.ceil(n * 0.25)
    # no grouping, other seeds draw other rows, the same seed the same
    draw = lambda seed, frame=df: {r.id for r in splits.split_exact(frame, ["id"], 0.1, seed=seed).where("type = 'test'").collect()}
    assert draw(1) == draw(1, df.repartition(5)) != draw(2)
    none = splits.split_exact(df, ["id"], 0.0, ["s"]).collect()
    assert len(none) == len(rows) and all(r.type == "train" for r in none)
    every = splits.split_exact(df, ["id"], 1.0, ["s"]).collect()
    assert len(every) == len(rows) and all(r.type == "test" for r in every)
    assert splits.split_exact(df.limit(0), ["id"], 0.5).collect() == []
