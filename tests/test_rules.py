"""Cleaning rules, functions, scaling, regression, evaluation, sources and the whole jobs."""

import json
import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline import schema
from wakeline.functions import performance as perf, weather as wx
from wakeline.operators import audit, classes, clean, evaluate, ridge, scaling
from wakeline.session import stage, stage_dir
from wakeline.sources import files


def test_missing_rules(spark):
    df = spark.createDataFrame(
        [(1, 8999.99, 1.0), (2, 9000.0, 1.0), (3, 9999.0, None), (4, None, None), (5, 1.0, 9500.0)],
        "i int, wind_u double, crnt_u double",
    )
    cols = ["wind_u", "crnt_u"]
    assert [r.i for r in clean.missing_ge(df, cols).orderBy("i").collect()] == [1, 4]
    assert [r.i for r in clean.missing_eq(df, cols).orderBy("i").collect()] == [1, 2, 4, 5]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in clean.nan_to_null(df, ["x"]).collect()] == [None, 1.0]


def test_safe_numeric_cast(spark):
    df = spark.createDataFrame([("1.5",), ("--",), ("",), (None,), ("nan",), (" 3 ",)], "rpm string")
    good, bad = clean.safe_numeric_cast(df, ["rpm"])
    assert sorted(str(r.rpm) for r in good.collect()) == ["1.5", "3.0", "None", "None"]
    assert sorted(r.rpm for r in bad.collect()) == ["", "--"]


def test_range_and_violations_are_no_complements(spark):
    df = spark.createDataFrame(
        [(10.0, 50.0, 5.0, 5.0, 1.0, 10.0, 100.0, 8.0), (5.0, 50.0, -1.0, 5.0, 1.0, 10.0, 100.0, 8.0)],
        "og_speed double, rpm double, draft_aft double, draft_fore double, foc_me double, "
        "speed_at_mcr double, rpm_at_mcr double, draft double",
    )
    # equal to its rating: dropped, yet no violation; negative draft: a violation, yet kept
    assert clean.rated_range(df).count() == 1
    assert clean.violation_counts(df).first().bad_og_speed == 0
    assert clean.violation_counts(df).first().bad_draft_aft == 1


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "ship_id int, client string, foc_me double")
    with pytest.raises(ValueError, match="absent"):
        schema.check_contract(df)
    assert len(schema.LEG_SCHEMA) == 35


def test_directions(spark):
    row = spark.createDataFrame([(1.0, 2.0, 90.0)], "u double, v double, course double")
    c = wx.deg2rad("course")
    got = row.select(
        wx.lg_from_uv("u", "v", c).alias("lg"),
        wx.tr_from_uv("u", "v", c).alias("tr"),
        wx.lg_from_uv_math("u", "v", c).alias("old"),
        wx.vector_dir(-F.col("u"), -F.col("v")).alias("dir"),
        wx.fold_degrees(F.lit(270.0)).alias("fold"),
        wx.fold_degrees(F.lit(180.0)).alias("half"),
    ).first()
    assert got.lg == pytest.approx(1.0) and got.tr == pytest.approx(-2.0) and got.old == pytest.approx(2.0)
    assert got.dir == pytest.approx(math.atan2(-2, -1) + 2 * math.pi)
    assert (got.fold, got.half) == (90.0, 180.0)


def test_zero_ratings_give_null(spark):
    row = spark.createDataFrame([(1.0, 0.0)], "rpm double, rpm_at_mcr double")
    assert row.select(perf.norm_rpm()).first()[0] is None
    assert row.select(perf.rebase_year(F.lit("x"))).first()[0] is None


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "val"), (5.0, 6.0, "test")], "x double, c double, type string")
    got = scaling.standardize_splits(df, ["x", "c"]).orderBy("type").collect()
    assert [(r.type, r.x, r.c) for r in got] == [("test", 3.0, 1.0), ("train", -1.0, 0.0), ("val", 1.0, 0.0)]


def test_r2_is_not_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 11.0), (2.0, 12.0), (3.0, 13.0), (0.0, 10.0)], "y double, p double")
    got = evaluate.metrics(df, [], "y", "p").first()
    assert got.r2 == pytest.approx(1 - 400 / 5) and got.mae == 10 and got.rmse == 10
    assert got.mape == pytest.approx(100 * (10 / 1 + 10 / 2 + 10 / 3) / 3)


def test_ridge_matches_direct_solution(spark):
    rng = np.random.default_rng(11)
    n, feats = 103, ["a", "b", "c"]
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 20, 3]
    y = x @ [2.0, -0.3, 9.0] + rng.normal(size=n) * 3
    rows = [(7, i * 3600, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "ship_id long, s long, a double, b double, c double, y double").withColumn(
        "utc", F.timestamp_seconds("s")
    )
    folded = ridge.with_folds(df, ["utc"], bucket_hours=10)
    train = n - math.ceil(n * 0.25)
    got_folds = [r.fold for r in folded.orderBy("utc").collect()]
    sizes = [train // 10 + (i < train % 10) for i in range(10)]
    assert got_folds == [f for f, m in enumerate(sizes) for _ in range(m)] + [-1] * (n - train)
    got = ridge.fit_ridge(folded, feats, "y").first()

    zx = (x[:train] - x[:train].mean(0)) / x[:train].std(0)
    zy = (y[:train] - y[:train].mean()) / y[:train].std()

    def fit(a, b, alpha):
        am, bm = a.mean(0), b.mean()
        w = np.linalg.solve((a - am).T @ (a - am) + alpha * np.eye(3), (a - am).T @ (b - bm))
        return w, bm - am @ w

    folds = np.array(got_folds[:train])
    best = None
    for alpha in ridge.ALPHAS:
        scores = []
        for f in range(10):
            w, b = fit(zx[folds != f], zy[folds != f], alpha)
            res, tot = zy[folds == f] - zx[folds == f] @ w - b, zy[folds == f] - zy[folds == f].mean()
            scores.append(1 - (res @ res) / (tot @ tot))
        if best is None or np.mean(scores) > best[0]:
            best = (np.mean(scores), alpha)
    w, _ = fit(zx, zy, best[1])
    assert got.alpha == best[1] and got.cv_r2 == pytest.approx(best[0])
    assert got.coef_std == pytest.approx(w.tolist())
    pred = ridge.predict(df.limit(3), ridge.fit_ridge(folded, feats, "y"), feats).orderBy("utc").collect()
    want = ((x[:3] - x[:train].mean(0)) / x[:train].std(0)) @ w * y[:train].std() + y[:train].mean()
    assert [r.pred for r in pred] == pytest.approx(want.tolist())


def test_classes_partition_ships(spark):
    rng = random.Random(4)
    rows = [
        (i, "BULK CARRIER", 100.0 + 10 * (i % 5), 20.0, 10.0, 8.0, 20000.0 * (1 + i % 5) + rng.random(), 10000.0, 9000.0)
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "ship_id long, ship_type string, length double, breadth double, depth double, "
                               "draft double, dwt double, gt double, power_at_mcr double")
    classed = classes.ship_classes(df, restarts=2)
    got = {r.ship_id: r.label for r in classed.collect()}
    assert got == {i: i % 5 for i in range(60)}
    assert [tuple(r) for r in classes.misplaced(classed).collect()] == [("BULK CARRIER", 60, 0)]


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]] + [(None,)], "v double")
    got = {r.bin: r.n_rows for r in audit.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 4: 1}
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [tuple(r) for r in audit.histogram(same, "v", 5).collect()] == [(2, 4)]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_raw_trees(spark, tmp_path):
    leg = {"client": "x", "foc_me": 10.0, "rpm": "70", "utc": "2020-01-01 00:00:00", "wind_u": 1.0}
    for tree, foc in (("corrected", 11.0), ("data", 10.0)):
        write(f"{tmp_path}/{tree}/4711/v1/a/leg.json", json.dumps([{**leg, "foc_me": foc}, {**leg, "utc": "2020-01-01 01:00:00"}]))
        write(f"{tmp_path}/{tree}/4711/v1/a/other.json", json.dumps([leg] * 5))
    write(f"{tmp_path}/data/4712/v1/b/leg.json", json.dumps([leg]))
    write(f"{tmp_path}/data/4712/draftlist.json", json.dumps([{"dep_utc": "2020-01-01T00:00:00", "arr_utc": "2020-01-09T00:00:00"}]))
    legs = files.scan_legs(spark, [f"{tmp_path}/corrected", f"{tmp_path}/data"])
    assert sorted({r.ship_id for r in legs.collect()}) == [4711, 4712] and legs.count() == 5
    first = clean.keep_first(legs, ["ship_id", "client", "utc"], ["source_rank"])
    kept = {(r.ship_id, r.utc): r.foc_me for r in first.collect()}
    assert kept[4711, "2020-01-01 00:00:00"] == 11.0 and len(kept) == 3
    trips = files.scan_draftlists(spark, [f"{tmp_path}/data"])
    assert [(r.ship_id, r.arr_utc.day) for r in trips.collect()] == [(4712, 9)]


def test_register_documents(spark, tmp_path):
    for ship, power in ((1, "9000"), (2, "unknown")):
        write(
            f"{tmp_path}/{ship}.xml",
            f"<ship><ship_id>{ship}</ship_id><ship_type>BULK CARRIER</ship_type><length>180.5</length><bhp>{power}</bhp></ship>",
        )
    got = {r.ship_id: (r.length, r.power_at_mcr) for r in files.scan_register_xml(spark, str(tmp_path)).collect()}
    assert got == {1: (180.5, 9000.0), 2: (180.5, None)}


def test_register_documents_with_real_tags(spark, tmp_path):
    write(
        f"{tmp_path}/7.xml",
        "<ship><wni_ship_num>7</wni_ship_num><ship_type>BULK CARRIER</ship_type><date_built>2009-05</date_built>"
        "<bhp>9000</bhp><teu>x</teu></ship>",
    )
    row = files.scan_register_xml(spark, str(tmp_path)).first()
    assert (row.ship_id, row.date_built, row.date_built_year, row.power_at_mcr, row.teu) == (7, "2009-05", 2009.0, 9000.0, None)


def test_bucket_pruning(spark, tmp_path, capsys):
    df = spark.range(1000).select((F.col("id") % 50).alias("ship_id"), F.col("id").cast("double").alias("foc_me"))
    files.columnar_checkpoint(df, f"{tmp_path}/legs")
    one = files.ship_slice(spark, f"{tmp_path}/legs", 7)
    assert one.count() == 20
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(ship_id), EqualTo(ship_id,7)]" in plan


def test_stage_folder_follows_the_session(spark):
    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    assert stage_dir(session("spark://host", spark_checkpoint_dir="hdfs://x/ck/")) == "hdfs://x/ck/wakeline/app-1"
    with pytest.raises(RuntimeError):
        stage_dir(session("spark://host"))
    assert stage_dir(spark) == stage_dir(spark)


def test_jobs_end_to_end(spark):
    from wakeline.catalog.registry import Reader
    from wakeline.plans import pipeline
    from wakeline.plans.features import feature_table

    t = Reader(spark, "/root/testdata/sf0.001")
    cols = ["ship_id", "client", "utc", *schema.MEASURED]
    rules = pipeline.CleaningRules(
        min_rows=60, gap_hours=24 * 40, min_run=5, low_fuel=0.0, change_band=(0.0, 1e9), bucket_hours=24 * 30
    )
    legs = t.f2_leg.select(*cols)
    cleaned = stage(pipeline.clean_telemetry(legs, t.f3_register, rules))
    kept = stage(pipeline.drop_outliers(cleaned, t.f3_register, rules))
    assert 0.85 < kept.count() / cleaned.where("ship_id IS NOT NULL").count() < 1
    records = stage(pipeline.telemetry_to_records(legs, t.f3_register, rules))
    assert set(records.columns) == set(schema.RECORD)
    assert records.count() > 500
    lengths = records.groupBy("record_index").agg(F.count(F.lit(1)).alias("n"), F.max("record_length").alias("l"))
    assert lengths.where("n <> l").count() == 0 and lengths.agg(F.min("l")).first()[0] >= 5
    feats = stage(feature_table(records, t.f3_register))
    assert feats.columns[:6] == schema.IDS and len(feats.columns) == 29
    exp = pipeline.Experiment("small", "foc_me", features=("draft_aft", "sig_ht", "normalized_rpm"), scale=("draft_aft", "sig_ht"))
    results = stage(pipeline.run_experiment(feats, t.f3_register, exp, bucket_hours=24 * 30))
    assert results.count() == feats.count()
    assert {r.type for r in results.select("type").distinct().collect()} == {"train", "val", "test"}
    report = pipeline.error_report(results, "foc_me")
    by_split = {r.type: r for r in report["by_split"].collect()}
    assert by_split["train"].r2 > -0.1 and by_split["test"].n_rows > 50
    assert report["by_run"].count() > 0 and report["coverage"].count() == 3


def test_leading_rows_hold_the_first_of_each_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([4, 5, 6]), rng.choice([None, 0.5, 1.5, float("nan")]), i) for i in range(200)]
    rows += [(1, None, 9.0, 900), (1, None, None, 901), (7, None, 1.0, 902), (8, 3, 1.0, 903)]
    df = spark.createDataFrame(rows, "k long, t long, x double, i long")
    few = clean.leading(df, ["k"], "t")
    least = {}
    for k, t, *_ in rows:
        least[k] = min(least.get(k, 99), -1 if t is None else t)
    assert sorted(r.i for r in few.collect()) == sorted(i for k, t, _, i in rows if least[k] == (-1 if t is None else t))
    first = lambda d: sorted(map(str, clean.keep_first(d, ["k"], ["t", "x"]).collect()))
    assert first(few) == first(df)
