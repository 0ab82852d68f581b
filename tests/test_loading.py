"""Two trees of record arrays loaded again and again."""

import glob
import gzip
import json
import os

from pyspark.sql import functions as F

from wakeline.operators import clean
from wakeline.sources import files, incremental


def put(root, ship, name, records):
    folder = f"{root}/{ship}/2019/{name}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/leg.json", "w") as f:
        json.dump(records, f)


def record(hour, foc, client="c"):
    return {"client": client, "utc": f"2019-01-01 {hour:02}:00:00", "foc_me": foc, "rpm": "80", "course": 1.0}


def state(table):
    """The data files of each bucket, with their times."""
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{table}/bucket=*/*.parquet")}


def rows(spark, table):
    return sorted((r.ship_id, r.utc, r.foc_me, r.source_rank) for r in files.read_columnar(spark, table).collect())


def test_incremental_load(spark, tmp_path):
    good, raw, table = f"{tmp_path}/data_error_corrected", f"{tmp_path}/data", f"{tmp_path}/legs"
    os.makedirs(good)
    for ship in range(1, 21):
        put(raw, ship, "1", [record(0, 1.0), record(1, 2.0)])
    load = lambda: sorted((r.change, r.ship_id) for r in incremental.load_trees(spark, [good, raw], table).collect())
    assert load() == [("added", s) for s in range(1, 21)]
    first = state(table)
    assert rows(spark, table) == [(s, f"2019-01-01 0{h}:00:00", 1.0 + h, 1) for s in range(1, 21) for h in (0, 1)]
    # nothing new: nothing written
    assert load() == [] and state(table) == first
    # a corrected file replaces its rows and leaves the others of the ship
    put(good, 7, "1", [record(1, 9.0), record(2, 5.0)])
    put(raw, 8, "2", [record(3, 4.0)])
    assert load() == [("added", 7), ("added", 8)]
    second = state(table)
    bucket = {r.ship_id: r.b for r in spark.range(1, 22).select(F.col("id").alias("ship_id"), incremental.bucket_of("id").alias("b")).collect()}
    touched = {f"bucket={bucket[7]}", f"bucket={bucket[8]}"}
    assert {os.path.basename(os.path.dirname(p)) for p in set(first.items()) ^ set(second.items()) for p in [p[0]]} == touched
    got = rows(spark, table)
    assert [r[1:] for r in got if r[0] == 7] == [
        ("2019-01-01 00:00:00", 1.0, 1), ("2019-01-01 01:00:00", 9.0, 0), ("2019-01-01 02:00:00", 5.0, 0)
    ]
    assert len(got) == 42
    # a file that changes, a file that goes, a file without records, a new ship
    put(raw, 9, "1", [record(0, 1.5)])
    os.remove(f"{raw}/10/2019/1/leg.json")
    put(raw, 11, "1", [])
    put(good, 21, "1", [record(0, 3.0)])
    assert load() == [("added", 21), ("changed", 9), ("changed", 11), ("removed", 10)]
    got = rows(spark, table)
    assert [r for r in got if r[0] in (9, 10, 11, 21)] == [(9, "2019-01-01 00:00:00", 1.5, 1), (21, "2019-01-01 00:00:00", 3.0, 0)]
    assert load() == []


def test_load_repeats_after_a_lost_manifest(spark, tmp_path):
    """Without its manifest the load is taken as not done and done again."""
    raw, table = f"{tmp_path}/data", f"{tmp_path}/legs"
    put(raw, 1, "1", [record(0, 1.0)])
    incremental.load_trees(spark, [raw], table)
    put(raw, 1, "2", [record(1, 2.0)])
    incremental.load_trees(spark, [raw], table)
    before = rows(spark, table)
    os.rename(f"{table}-manifest/version=2", f"{tmp_path}/lost")
    again = incremental.load_trees(spark, [raw], table).collect()
    assert [(r.change, r.ship_id) for r in again] == [("added", 1)]
    assert rows(spark, table) == before and len(before) == 2


def test_only_touched_files_are_read(spark, tmp_path):
    raw, table = f"{tmp_path}/data", f"{tmp_path}/legs"
    for ship in range(30):
        put(raw, ship, "1", [record(0, 1.0)])
    incremental.load_trees(spark, [raw], table)
    legs = files.scan_legs(spark, [raw]).withColumn("bucket", incremental.bucket_of())
    some = legs.where(F.col("bucket").isin([r.b for r in spark.range(3).select(incremental.bucket_of("id").alias("b")).collect()]))
    scan = some.select("foc_me")
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in plan or "file_path" in plan
    read = scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert read < 10


def test_record_arrays_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 1.5, "x"), (1, 20, None, "ÿ\"\n"), (2, 10, 2.0, None)], "ship int, decade int, foc_me double, client string")
    files.write_record_arrays(df, f"{tmp_path}/t", ["ship", "decade"])
    names = glob.glob(f"{tmp_path}/t/ship=*/decade=*/*.txt")
    assert len(names) == 3 and all(isinstance(json.load(open(n)), list) for n in names)
    read = files.scan_json_tree(spark, f"{tmp_path}/t", df.drop("ship", "decade").schema, "*.txt", 3, True)
    assert sorted(map(str, (tuple(r) for r in read.collect()))) == sorted(map(str, [(1.5, "x", 1), (None, "ÿ\"\n", 1), (2.0, None, 2)]))


def test_record_arrays_stream_and_pack(spark, tmp_path):
    """Packed files hold the same rows; rows are shuffled as columns, once, and no array is gathered."""
    rows = [(s, i, f"r{i}") for s in (1, 2, 3) for i in range(50)]
    df = spark.createDataFrame(rows, "ship int, n int, note string")
    files.write_record_arrays(df, f"{tmp_path}/t", ["ship"], "gzip")
    names = glob.glob(f"{tmp_path}/t/ship=*/*.txt.gz")
    assert len(names) == 3
    assert all(len(json.load(gzip.open(n, "rt"))) == 50 for n in names)
    read = files.scan_json_tree(spark, f"{tmp_path}/t", None, "*.txt.gz", 2, True)
    assert sorted(map(str, (tuple(r) for r in read.select("ship_id", "n", "note").collect()))) == sorted(map(str, rows))


def test_schema_of_many_small_files_is_many_tasks(spark, tmp_path):
    """Types of all files count, and the files are dealt to more than one task."""
    for ship in range(80):
        os.makedirs(f"{tmp_path}/{ship}")
        with open(f"{tmp_path}/{ship}/draftlist.json", "w") as f:
            json.dump([{"dep_utc": "2019-01-01 00:00:00", "cargo": 1 if ship else 1.5}, {f"c{ship % 3}": "x"}], f, indent=1)
    found = files.schema_of_arrays(spark, str(tmp_path), "draftlist.json")
    assert found.simpleString() == "struct<c0:string,c1:string,c2:string,cargo:double,dep_utc:string>"
    text = spark.read.option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True)
    assert text.rdd.getNumPartitions() > 1
    lists = files.scan_draftlists(spark, [str(tmp_path)])
    assert lists.count() == 160 and dict(lists.dtypes)["cargo"] == "double"


def test_few_folders_are_written_without_a_sort(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("client"))
    before = spark.conf.get(files.WRITERS)
    for folders in (3, 20):
        path = f"{tmp_path}/{folders}"
        files.sink_table(df.withColumn("client", (F.col("id") % folders).cast("string")), path, ["client"])
        assert len(glob.glob(f"{path}/client=*")) == folders and spark.read.parquet(path).count() == 100
    assert spark.conf.get(files.WRITERS) == before


def test_arrays_lie_where_sparks_folders_would(spark, tmp_path):
    """Folders are named as Spark names them, nulls and signs included; nothing but the arrays lies in them."""
    marks = ["a/b", "x=1", "50% \\ [z]^", "ü", " ", "", None, "{q}:*?'\"#", "t\ta"]
    df = spark.createDataFrame([(i % 3 if i % 4 else None, m, f"r{i}") for i in range(3) for m in marks], "ship int, mark string, note string")
    files.write_record_arrays(df, f"{tmp_path}/t", ["ship", "mark"], "gzip")
    df.write.partitionBy("ship", "mark").text(f"{tmp_path}/s")
    folders = lambda top: {os.path.relpath(d, top) for d, _, names in os.walk(top) if any(n.startswith("part-") for n in names)}
    assert folders(f"{tmp_path}/t") == folders(f"{tmp_path}/s")
    # no checksum files either: each would start a process, as would each file and folder
    names = [n for _, _, names in os.walk(f"{tmp_path}/t") for n in names]
    assert len(names) == 24 == len(folders(f"{tmp_path}/t")) and all(n.startswith("part-") and n.endswith(".txt.gz") for n in names)
    read = spark.read.option("multiLine", True).schema("note string").json(f"{tmp_path}/t")
    assert sorted(r.note for r in read.select("note").collect()) == sorted(r.note for r in df.collect())


def test_arrays_of_many_batches(spark, tmp_path):
    """A directory whose rows come in several batches is one array; one without rows leaves an empty tree."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("ship"), F.col("id").alias("n"))
        files.write_record_arrays(df, f"{tmp_path}/t", ["ship"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    arrays = {n: json.load(open(n)) for n in glob.glob(f"{tmp_path}/t/ship=*/*")}
    assert len(arrays) == 3
    assert sorted(r["n"] for a in arrays.values() for r in a) == list(range(100))
    assert all(r["n"] % 3 == int(n.split("ship=")[1][0]) for n, a in arrays.items() for r in a)
    files.write_record_arrays(df.where("false"), f"{tmp_path}/e", ["ship"])
    assert files.scan_legs(spark, [f"{tmp_path}/e"], file_glob="*.txt").count() == 0


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """The scan's tasks are bounded however many files there are, and so are those that list their folders."""
    df = spark.range(600).select((F.col("id") % 200).alias("ship"), F.lit(1).alias("a"), F.lit(1).alias("b"), F.col("id").cast("string").alias("client"))
    files.write_record_arrays(df, f"{tmp_path}/t", ["ship", "a", "b"])
    bound, size = files.file_tasks(spark), "spark.sql.files.maxPartitionBytes"
    before, listing = spark.conf.get(size), spark.conf.get(files.LISTING)
    spark.conf.set(size, "4m")
    try:
        legs = files.scan_legs(spark, [f"{tmp_path}/t"], file_glob="*.txt")
        assert bound < 200 and legs.rdd.getNumPartitions() == bound
        assert incremental.file_manifest(spark, [f"{tmp_path}/t"], "*.txt").rdd.getNumPartitions() <= bound
        assert sorted(int(r.client) for r in legs.collect()) == list(range(600))
        assert {(r.ship_id, int(r.client) % 200) for r in legs.collect()} == {(s, s) for s in range(200)}
    finally:
        spark.conf.set(size, before)
    # and listing goes back to what the session had
    assert spark.conf.get(files.LISTING) == listing


def test_a_load_shuffles_rows_once(spark, tmp_path, monkeypatch):
    """Rows of a bucket meet once; a bucket of large files is written in parts that keep all copies of a key together."""
    legs = spark.createDataFrame([(b, b % 2, k, r, v) for b in range(4) for k in range(5) for r, v in ((1, 1.0), (0, 2.0), (0, 3.0))], "bucket int, _part int, ship_id int, source_rank int, v double")
    first = clean.keep_first(legs, ["bucket", "_part", "ship_id"], rank=["source_rank"], meet=["bucket", "_part"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert sorted((r.bucket, r.ship_id, r.source_rank, r.v) for r in first.collect()) == [(b, k, 0, 2.0) for b in range(4) for k in range(5)]
    monkeypatch.setattr(incremental, "PART_BYTES", 400)
    good, raw, table = f"{tmp_path}/good", f"{tmp_path}/raw", f"{tmp_path}/legs"
    put(raw, 1, "1", [record(h, float(h)) for h in range(24)] * 2)
    put(raw, 2, "1", [record(0, 1.0)])
    put(good, 1, "1", [record(h, 9.0) for h in range(0, 24, 2)])
    incremental.load_trees(spark, [good, raw], table)
    got = [r[2:] for r in rows(spark, table) if r[0] == 1]
    assert got == [(9.0, 0) if h % 2 == 0 else (float(h), 1) for h in range(24)]
    buckets = {b: len(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{table}/bucket=*")}
    assert len(buckets) == 2 and min(buckets.values()) == 1


def test_arrays_on_a_file_system_only_spark_reads(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.arrays.link./in", f"file://{tmp_path}")
    root = "viewfs://arrays/in/t"
    assert files.local_folder(spark, root) is None and files.local_folder(spark, f"file://{tmp_path}/t") == f"{tmp_path}/t"
    df = spark.range(30).select((F.col("id") % 3).alias("ship"), F.lit(1).alias("a"), F.lit(1).alias("b"), F.col("id").cast("string").alias("client"))
    files.write_record_arrays(df, root, ["ship", "a", "b"], "gzip")
    assert len(glob.glob(f"{tmp_path}/t/ship=*/a=1/b=1/*.txt.gz")) == 3
    read = files.scan_legs(spark, [root], file_glob="*.txt.gz").select("ship_id", "client").collect()
    assert sorted((int(r.client), r.ship_id) for r in read) == [(i, i % 3) for i in range(30)]
