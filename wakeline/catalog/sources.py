"""Sources and sinks. Trees and files are staged by Spark from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import clean, evaluate, runs
from ..schema import LEG_SCHEMA
from ..session import stage_path
from ..sources import files, incremental
from .registry import query, r, rc, rounded
from .series import ALL_F2, runs_sql


def leg_rows(t, corrected: bool = False) -> DataFrame:
    """The fixture as records of the declared schema beside their directories; corrected ones burn a tonne more."""
    legs = t.f2_leg
    if corrected:
        legs = legs.where("client = 'R' AND ship_id % 7 < 3").withColumn("foc_me", F.col("foc_me") + 1)
    return legs.select(
        F.col("ship_id").alias("ship"),
        (F.floor(F.year("utc") / 10) * 10).alias("decade"),
        F.lit(1).alias("part"),
        *[c for c in LEG_SCHEMA.fieldNames() if c in legs.columns and c not in ("utc", "rpm")],
        F.col("rpm").cast("string").alias("rpm"),
        F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("utc"),
    )


def staged_legs(t, corrected: bool = False) -> str:
    """A telemetry tree <root>/ship=../decade=../part=../*.txt.gz, each file one packed array of records."""
    root = stage_path(t.spark, "corrected-tree" if corrected else "leg-tree")
    files.write_record_arrays(leg_rows(t, corrected), root, ["ship", "decade", "part"], "gzip")
    return root


def read_legs(t, roots: list[str]) -> DataFrame:
    return files.scan_legs(t.spark, roots, file_glob="*.txt.gz")


# corrected records before raw ones
TWO_TREES = """(SELECT *, 1 AS source_rank FROM f2_leg UNION ALL
    SELECT * REPLACE (foc_me + 1 AS foc_me), 0 FROM f2_leg WHERE client = 'R' AND ship_id % 7 < 3)"""
LEG_OUT = f"""ship_id, client, {r('CAST(foc_me AS FLOAT)', 4)} AS foc_me, {r('CAST(wind_u AS FLOAT)', 4)} AS wind_u,
    strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc_text"""


def leg_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "ship_id", "client", rc("foc_me", 4).alias("foc_me"), rc("wind_u", 4).alias("wind_u"), F.col("utc").alias("utc_text"), *more
    )


@query("scan_leg_json", f"SELECT {LEG_OUT}, source_rank FROM {TWO_TREES}")
def _(t):
    """Both trees, each file an array of records."""
    legs = read_legs(t, [staged_legs(t, corrected=True), staged_legs(t)])
    return leg_out(legs, "source_rank")


ABSENT = ["deadweight", "foc_total", "load", "loading_condition", "point_type", "power", "sst", "tw_speed"]
_COUNTS = ", ".join(f"{'0' if c in ABSENT else f'count({c})'} AS n_{c}" for c in LEG_SCHEMA.fieldNames())


@query(
    "leg_schema",
    f"""SELECT ship_id, {r('avg(foc_me)')} AS foc_me, {r('avg(CAST(rpm AS FLOAT))', 3)} AS avg_rpm, {_COUNTS}
        FROM f2_leg GROUP BY ship_id""",
)
def _(t):
    """All declared columns: how many rows have each; columns no file has are null."""
    legs = read_legs(t, [staged_legs(t)])
    typed, _rejected = clean.safe_numeric_cast(legs.select("ship_id", *LEG_SCHEMA.fieldNames()), ["rpm"])
    counts = [F.count(c).cast("int" if c in ABSENT else "long").alias(f"n_{c}") for c in LEG_SCHEMA.fieldNames()]
    return typed.groupBy("ship_id").agg(rc(F.avg("foc_me")).alias("foc_me"), rc(F.avg("rpm"), 3).alias("avg_rpm"), *counts)


_TRIPS = "ship_id, dep_utc, arr_utc, 'c' || CAST(ship_id % 7 AS VARCHAR) AS cargo, ship_id % 11 AS draft_dm"


@query(
    "scan_draftlist_json",
    f"""SELECT {_TRIPS}, 1 AS source_rank FROM f4_voyage UNION ALL
        SELECT * REPLACE ('corrected' AS cargo), 0 FROM (SELECT {_TRIPS} FROM f4_voyage WHERE ship_id % 5 = 0)""",
)
def _(t):
    """Voyage lists of both trees, each file an array of records, all their columns."""
    rows = t.f4_voyage.withColumn("cargo", F.expr("'c' || ship_id % 7")).withColumn("draft_dm", F.expr("ship_id % 11"))
    rows = rows.withColumnRenamed("ship_id", "ship")
    roots = [stage_path(t.spark, "corrected-draftlists"), stage_path(t.spark, "draftlists")]
    files.write_record_arrays(rows.where("ship % 5 = 0").withColumn("cargo", F.lit("corrected")), roots[0], ["ship"], "gzip")
    files.write_record_arrays(rows, roots[1], ["ship"], "gzip")
    return files.scan_draftlists(t.spark, roots, file_glob="*.txt.gz")


_FIRST = f"""SELECT ship_id, client, strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc, min(source_rank) AS source_rank,
    {r('CAST(arg_min(foc_me, source_rank * 1000 + foc_me) AS FLOAT)', 4)} AS foc_me FROM {TWO_TREES} GROUP BY ship_id, client, utc"""


@query("source_precedence", _FIRST)
def _(t):
    """The two trees read together; of one key the corrected record stays."""
    legs = read_legs(t, [staged_legs(t, corrected=True), staged_legs(t)])
    first = clean.keep_first(legs.select("ship_id", "client", "utc", "foc_me", "source_rank"), ["ship_id", "client", "utc"], rank=["source_rank"])
    return rounded(first, ["foc_me"], 4)


def two_loads(t):
    """A table loaded from the raw tree, then again with the corrected tree in front; what each load saw change."""
    table = stage_path(t.spark, "legs-by-bucket")
    raw = staged_legs(t)
    empty = stage_path(t.spark, "no-corrections")
    t.spark.createDataFrame([], "value string").write.text(empty)
    changes = [incremental.load_trees(t.spark, [empty, raw], table, "*.txt.gz")]
    changes.append(incremental.load_trees(t.spark, [staged_legs(t, corrected=True), raw], table, "*.txt.gz"))
    return table, changes


# of equal keys in one tree the first by all columns stays
_LOADED = f"""SELECT ship_id, client, utc, source_rank, foc_me FROM (SELECT ship_id, client, strftime(utc, '%Y-%m-%d %H:%M:%S') AS utc,
    CAST(source_rank AS INTEGER) AS source_rank, {r('CAST(foc_me AS FLOAT)', 4)} AS foc_me, row_number() OVER (PARTITION BY ship_id, client, utc
    ORDER BY source_rank, course, crnt_u, crnt_v, draft_aft, draft_fore, foc_me) AS rn FROM {TWO_TREES}) WHERE rn = 1"""


@query("incremental_load", _LOADED)
def _(t):
    """The table after two loads, the second of which rewrote only the buckets of corrected ships."""
    table, _changes = two_loads(t)
    rows = files.read_columnar(t.spark, table).select("ship_id", "client", "utc", "source_rank", "foc_me")
    return rounded(rows, ["foc_me"], 4)


@query(
    "load_changes",
    f"""WITH f AS (SELECT DISTINCT ship_id, floor(year(utc) / 10) AS decade, source_rank FROM {TWO_TREES})
        SELECT 2 - source_rank AS load, 'added' AS change, source_rank, count(*) AS n_files, count(DISTINCT ship_id) AS n_ships
        FROM f GROUP BY source_rank""",
)
def _(t):
    """Files and ships that each load found changed."""
    _table, changes = two_loads(t)
    told = [c.withColumn("load", F.lit(i + 1)) for i, c in enumerate(changes)]
    return told[0].unionByName(told[1]).groupBy("load", "change", "source_rank").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("ship_id").alias("n_ships")
    )


@query("columnar_checkpoint", f"SELECT ship_id, client, utc, {r('foc_me')} AS foc_me FROM f2_leg")
def _(t):
    path = stage_path(t.spark, "legs")
    files.columnar_checkpoint(t.f2_leg.select("ship_id", "client", "utc", "foc_me"), path)
    return rounded(files.read_columnar(t.spark, path), ["foc_me"])


@query("scan_csv_typed", f"SELECT ship_id, utc, {r('CAST(og_speed AS FLOAT)', 3)} AS og_speed FROM f2_leg")
def _(t):
    path = stage_path(t.spark, "legs-csv")
    cols = ["ship_id", "client", "utc", "foc_me", "og_speed"]
    files.sink_csv(t.f2_leg.select(*cols), path)
    schema = T.StructType(
        [
            T.StructField("ship_id", T.LongType()),
            T.StructField("client", T.StringType()),
            T.StructField("utc", T.TimestampNTZType()),
            T.StructField("foc_me", T.FloatType()),
            T.StructField("og_speed", T.FloatType()),
        ]
    )
    return rounded(files.scan_csv_typed(t.spark, path, schema, ["ship_id", "utc", "og_speed"]), ["og_speed"], 3)


@query("sink_csv", "SELECT ship_id, record_index, type FROM f5_prediction")
def _(t):
    path = stage_path(t.spark, "predictions-csv")
    files.sink_csv(t.f5_prediction.select("ship_id", "record_index", "type"), path)
    return t.spark.read.schema("ship_id long, record_index long, type string").option("header", True).csv(path)


@query("scan_ship_register", "SELECT ship_id, ship_type, length, dwt, power_at_mcr, date_built_year FROM f3_register")
def _(t):
    path = stage_path(t.spark, "register-csv")
    raw = t.f3_register.withColumnsRenamed({"ship_id": "wni_ship_num", "power_at_mcr": "bhp"})
    files.sink_csv(raw, path)
    text = t.spark.read.option("header", True).csv(path)
    return files.scan_register(text).select("ship_id", "ship_type", "length", "dwt", "power_at_mcr", "date_built_year")


@query("scan_register_xml", """SELECT ship_id, ship_type, length, depth, power_at_mcr, rpm_at_mcr, CAST(CAST(date_built_year AS INTEGER) AS VARCHAR) || '-05-01' AS date_built,
         date_built_year, CAST(ship_id * 10 AS DOUBLE) AS teu FROM f3_register""")
def _(t):
    path = stage_path(t.spark, "register-xml")
    raw = t.f3_register.drop("label").withColumnsRenamed({"power_at_mcr": "bhp", "ship_id": "wni_ship_num"})
    raw = raw.withColumn("date_built", F.concat(F.col("date_built_year").cast("int"), F.lit("-05-01"))).drop("date_built_year")
    raw = raw.withColumn("teu", F.col("wni_ship_num") * 10)
    raw.write.format("xml").option("rowTag", "ship").option("rootTag", "ships").save(path)
    read = files.scan_register_xml(t.spark, path)
    return read.select("ship_id", "ship_type", "length", "depth", "power_at_mcr", "rpm_at_mcr", "date_built", "date_built_year", "teu")


@query(
    "stage_tables",
    "SELECT client, count(*) AS n_rows FROM f2_leg WHERE sea_dir > 0 AND swl_dir > 0 GROUP BY client",
)
def _(t):
    path = stage_path(t.spark, "stage-table")
    files.sink_table(clean.dir_positive(t.f2_leg), path, partition_by=["client"])
    return t.spark.read.parquet(path).groupBy("client").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "union_label_results",
    f"""SELECT ship_id, record_index, utc, label, {r('pred_tw_speed')} AS pred FROM f5_prediction
        JOIN (SELECT ship_id, label FROM f3_register) USING (ship_id) ORDER BY ship_id, record_index, utc""",
)
def _(t):
    root = stage_path(t.spark, "class-results")
    labelled = t.f5_prediction.join(t.f3_register.select("ship_id", "label"), "ship_id")
    labelled.write.partitionBy("label").parquet(root)
    schema = labelled.drop("label").schema
    # the classes are whatever folders there are; rows without one stay
    together = t.spark.read.schema(T.StructType([*schema.fields, T.StructField("label", T.IntegerType())])).parquet(root)
    return together.select("ship_id", "record_index", "utc", "label", rc("pred_tw_speed").alias("pred")).orderBy(
        "ship_id", "record_index", "utc"
    )


@query(
    "sink_predictions",
    f"SELECT type, count(*) AS n_rows, {r('avg(abs(tw_speed - pred_tw_speed))')} AS mae FROM f5_prediction GROUP BY type",
)
def _(t):
    path = stage_path(t.spark, "predictions")
    files.sink_table(t.f5_prediction, path, partition_by=["type"])
    back = t.spark.read.parquet(path)
    return rounded(evaluate.metrics(back, ["type"], "tw_speed", "pred_tw_speed", ["mae"]), ["mae"])


@query(
    "sink_duplicates",
    f"""SELECT ship_id, client, utc, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER
        (PARTITION BY ship_id, client, utc ORDER BY {ALL_F2}) AS rn FROM f2_leg) WHERE rn > 1""",
)
def _(t):
    path = stage_path(t.spark, "duplicates")
    rank = [c.strip() for c in ALL_F2.split(",")]
    files.sink_table(clean.duplicate_rows(t.f2_leg, ["ship_id", "client", "utc"], rank), path)
    return t.spark.read.parquet(path).select("ship_id", "client", "utc", "l_orderkey", "l_linenumber")


@query(
    "sink_run_intervals",
    f"""WITH {runs_sql('f1_leg_events')} SELECT record_index, any_value(ship_id) AS ship_id, min(utc) AS start_utc,
          max(utc) AS end_utc FROM runs WHERE record_length >= 3 GROUP BY record_index""",
)
def _(t):
    path = stage_path(t.spark, "run-intervals")
    table = runs.run_table(runs.min_run_length(runs.continuous_runs(t.f1_leg_events), 3))
    files.sink_table(table.select("record_index", "ship_id", "start_utc", "end_utc"), path)
    return t.spark.read.parquet(path)


@query("extract_ship", "SELECT client, utc, foc_me, og_speed FROM f2_leg WHERE ship_id = 7")
def _(t):
    one = t.f2_leg.where("ship_id = 7").select("client", "utc", "foc_me", "og_speed")
    out = stage_path(t.spark, "ship-csv")
    files.sink_csv(one, out)
    schema = T.StructType(
        [
            T.StructField("client", T.StringType()),
            T.StructField("utc", T.TimestampNTZType()),
            T.StructField("foc_me", T.DoubleType()),
            T.StructField("og_speed", T.DoubleType()),
        ]
    )
    return files.scan_csv_typed(t.spark, out, schema)
