"""Stage tables take no more disk than they need: shuffles go with the write, blocks with the fit."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from wakeline.operators import dense, sized
from wakeline.session import DROP_SHUFFLES, discard, stage, stage_dir


def shuffle_files(spark):
    listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(listed.size()) if "shuffle_" in (name := listed.apply(i).getName())}


def test_a_stage_leaves_no_shuffle(spark):
    before, held = shuffle_files(spark), spark.conf.get(DROP_SHUFFLES)
    table = stage(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(40):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(DROP_SHUFFLES) == held
    assert sorted(table.collect()) == [(k, 500) for k in range(10)]


def test_discard_removes_the_table_alone(spark):
    first, second = stage(spark.range(10), "first"), stage(spark.range(20), "second")
    folders = [t.inputFiles()[0].rsplit("/", 1)[0].split("file:")[-1].replace("///", "/") for t in (first, second)]
    assert all(os.path.isdir(f) for f in folders)
    discard(first)
    assert not os.path.exists(folders[0]) and second.count() == 20


def test_small_tables_are_broadcast(spark, monkeypatch):
    """Equal keys of the small side each find their rows, NULL finds none; a table that does not fit carries no hint."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    table = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0)], "k long, w double")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        for bound, kind in ((sized.BROADCAST_BYTES, "BroadcastHashJoin"), (100, "SortMergeJoin")):
            monkeypatch.setattr(sized, "BROADCAST_BYTES", bound)
            joined = rows.join(sized.small(table).select("k", "w"), "k", "left")
            assert kind in joined._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, map(tuple, joined.collect()))) == ["(1, 'a', 1.0)", "(1, 'a', 2.0)", "(2, 'b', None)", "(None, 'c', None)"]
    finally:
        spark.conf.set(conf, before)


def some_rows(spark, n=900):
    rng = np.random.default_rng(5)
    data = [(i, i % 2, "val" if i % 5 == 0 else "train", float(rng.normal()), float(i % 3) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(data, "id long, g long, type string, a double, b double").withColumn("y", F.col("a") + 1)


def test_blocks_in_slices_hold_the_same_rows(spark, monkeypatch):
    df = some_rows(spark)
    want = {tuple(r[:3]): (r.x, r.y) for r in dense.deal_blocks(df, ["a", "b"], "y", "g", ["id"], block_rows=40).collect()}
    for least, n_tables in ((10**6, 1), (1, dense.SLICES)):
        monkeypatch.setattr(dense, "SLICED_BLOCKS", least)
        staged = dense.stage_blocks(df, ["a", "b"], "y", "g", ["id"], block_rows=40)
        assert len({f.rsplit("/", 1)[0] for f in staged.inputFiles()}) == n_tables
        got = {tuple(r[:3]): ([v for pair in zip(r.x0, r.x1) for v in pair], r.y) for r in staged.collect()}
        assert got == want and sum(len(y) for _, y in got.values()) == df.where("b IS NOT NULL").count()


def test_a_fit_removes_its_blocks(spark, monkeypatch):
    df, net = some_rows(spark), dense.Net(layers=((4, "relu", 0.0),), loss="mse", rounds=2, block_rows=40)
    folders = lambda: {f for f in os.listdir(stage_dir(spark)) if f.startswith("dense-blocks")}
    before = folders()
    fits = []
    for least in (10**6, 1):
        monkeypatch.setattr(dense, "SLICED_BLOCKS", least)
        models, history = dense.fit_dense(df, ["a", "b"], "y", "g", ["id"], net)
        fits.append({r.group: (r.round, np.frombuffer(bytes(r.weights))) for r in models.collect()})
        assert history.count() == 6 and folders() == before
    assert fits[0].keys() == fits[1].keys() == {0, 1}
    for g, (n, weights) in fits[0].items():
        assert fits[1][g][0] == n and np.allclose(weights, fits[1][g][1])
    none, _ = dense.fit_dense(df.where("false"), ["a", "b"], "y", "g", ["id"], net)
    assert none.count() == 0
