"""Reading the raw trees and tables, writing stage tables and sinks."""

from __future__ import annotations

import gzip
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.sized import spread
from ..schema import LEG_FLOAT, LEG_SCHEMA, REGISTER_NUMERIC, REGISTER_OPTIONAL
from ..session import setting

# Elements of a ship document.
REGISTER_XML_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [
        "wni_ship_num", "ship_id", "ship_type", "length", "breadth", "depth", "draft", "dwt", "gt", "bhp", "speed_at_mcr",
        "rpm_at_mcr", "date_built", "teu",
    ]]
)
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_WRITERS = 8
GZIP_LEVEL = 3  # of record arrays: 84 MB a second, 0.16 of their bytes; 6 packs 35 MB to 0.13
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
RENAMES = {"wni_ship_num": "ship_id", "bhp": "power_at_mcr"}


def file_tasks(spark: SparkSession) -> int:
    """Tasks that share the files of a tree, however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def list_tree(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """What ``load`` returns, its folders listed by a bounded number of tasks: by default one for each, up to 10,000."""
    with setting(spark, LISTING, str(file_tasks(spark))):
        return load()


def path_id(level: int, path: str = "_metadata.file_path") -> Column:
    """The number that ends the ``level``-th path element from the right of the row's file.

    Accepts plain directories (``4711``) and partition directories (``ship=4711``).
    """
    element = F.element_at(F.split(F.col(path), "/"), F.lit(-level))
    return F.regexp_extract(element, "([0-9]+)$", 1).cast("long")


def scan_json_tree(
    spark: SparkSession, root: str, schema: T.StructType | None, file_glob: str, id_level: int, multi_line: bool
) -> DataFrame:
    """Every matching file below ``root``; ``ship_id`` comes from the directory name.

    Without a schema all columns found in the files are read, with the types they have there.
    """
    if schema is None and multi_line:
        schema = schema_of_arrays(spark, root, file_glob)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).option("multiLine", multi_line)
    raw = list_tree(spark, lambda: reader.json(root))
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns if c != "ship_id"], path_id(id_level).alias("ship_id"))


def schema_of_arrays(spark: SparkSession, root: str, file_glob: str) -> T.StructType:
    """Columns and types of all matching files, each read whole as one text (UTF-8).

    The JSON reader's own look at multi-line files deals them by bytes alone: any number of small files is one task.
    A text scan counts the cost of opening each.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_glob)
    texts = list_tree(spark, lambda: reader.text(root, wholetext=True))
    return spark.read.json(texts.rdd.map(lambda row: row[0])).schema


def scan_legs(
    spark: SparkSession,
    roots: list[str],
    file_glob: str = "leg.json",
    multi_line: bool = True,
    schema: T.StructType = LEG_SCHEMA,
) -> DataFrame:
    """Telemetry of all trees. ``source_rank`` is the tree's place in ``roots``: corrected data first.

    Layout: <root>/<ship>/<a>/<b>/leg.json, each file a JSON array of records. The scan packs files by their opening
    cost, which makes a task of every few small ones; they are read one after the other in a bounded number of tasks.
    """
    parts = [
        scan_json_tree(spark, root, schema, file_glob, 4, multi_line).withColumn("source_rank", F.lit(rank))
        for rank, root in enumerate(roots)
    ]
    legs = reduce(DataFrame.unionByName, parts).coalesce(file_tasks(spark))
    floats = [c for c in LEG_FLOAT if c in legs.columns]
    return legs.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("float")) for c in floats})


def scan_draftlists(
    spark: SparkSession,
    roots: list[str],
    file_glob: str = "draftlist.json",
    multi_line: bool = True,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Voyage lists: <root>/<ship>/draftlist.json, all columns; dep_utc and arr_utc as times."""
    parts = [
        scan_json_tree(spark, root, schema, file_glob, 2, multi_line).withColumn("source_rank", F.lit(rank))
        for rank, root in enumerate(roots)
    ]
    voyages = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    times = [c for c in ("dep_utc", "arr_utc") if c in voyages.columns]
    return voyages.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in times})


def write_json_tree(df: DataFrame, root: str, dirs: list[str]) -> None:
    """Write rows below one directory level per column of ``dirs``.

    Rows of one directory may come from several tasks: a large ship is written in parallel.
    """
    df.write.partitionBy(*dirs).json(root)


def write_record_arrays(df: DataFrame, root: str, dirs: list[str], compression: str = "none") -> None:
    """One file for each directory of ``dirs``, holding its rows as one JSON array of records.

    Rows meet by directory as columns, once, and are written line after line in the order of that sort: an array is
    never held whole. The spread has a fixed number of tasks, as creating a file costs more than its bytes.
    Tasks write to a plain folder by themselves: without Hadoop's native library its local file system starts
    processes for the permissions of every file and directory. Other file systems are written by Spark.
    """
    folder = local_folder(df.sparkSession, root)
    # values meet by the name of their folder, which empty texts share with NULL
    df = df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in dirs})
    record = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in dirs]))
    if folder is None or compression not in ("none", "gzip"):
        place = Window.partitionBy(*dirs).orderBy(*dirs)
        head = F.when(F.row_number().over(place) == 1, "[\n").otherwise("")
        tail = F.when(F.lead(F.lit(1)).over(place).isNull(), "\n]").otherwise(",")
        lines = spread(df, *dirs).select(*dirs, F.concat(head, record, tail).alias("value"))
        lines.write.partitionBy(*dirs).option("compression", compression).text(root)
        return
    os.makedirs(folder)
    at = F.to_json(F.array(*dirs))
    lines = spread(df, *dirs).sortWithinPartitions(*dirs).select(at.alias("at"), record.cast("binary").alias("value"))
    lines.mapInArrow(_array_writer(folder, dirs, compression == "gzip"), "n_files long").agg(F.sum("n_files")).collect()


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of a path of the local file system, else None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def folder_name(column: str, value: str | None) -> str:
    """The partition directory Spark would write."""
    escaped = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "")
    return f"{column}={escaped or NO_VALUE}"


def _array_writer(folder: str, dirs: list[str], packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of (directory, record), sorted by directory, to one file each. A file gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05}.txt" + (".gz" if packed else "")
        last = out = draft = None
        n_files = 0

        def finish() -> None:
            out.write(b"\n]\n")
            out.close()
            os.replace(draft, os.path.join(os.path.dirname(draft), name))

        for batch in batches:
            runs, start = pc.run_end_encode(batch.column(0)), 0
            for at, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if at == last:
                    out.write(b",\n")
                else:
                    if out is not None:
                        finish()
                    here = os.path.join(folder, *[folder_name(c, v) for c, v in zip(dirs, json.loads(at))])
                    os.makedirs(here, exist_ok=True)
                    draft = os.path.join(here, f".{name}-{task.taskAttemptId()}")
                    out = gzip.open(draft, "wb", GZIP_LEVEL) if packed else open(draft, "wb")
                    out.write(b"[\n")
                    last, n_files = at, n_files + 1
                out.write(b",\n".join(batch.column(1).slice(start, end - start).to_pylist()))
                start = end
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"n_files": pa.array([n_files], pa.int64())})

    return run


def columnar_checkpoint(df: DataFrame, path: str, buckets: int = 256, key: str = "ship_id") -> None:
    """Parquet partitioned by a hash bucket of the ship, the stage format of concatenated legs.

    Rows meet by bucket and a random part of it before the write, so a bucket has a few files of even size;
    the rebalance hint lets adaptive execution split a bucket that one ship fills.
    """
    keyed = df.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
    keyed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def ship_slice(spark: SparkSession, path: str, ship_id: int, buckets: int = 256) -> DataFrame:
    """One ship of a columnar checkpoint: only its bucket directory is listed and read."""
    bucket = F.pmod(F.hash(F.lit(ship_id).cast("long")), F.lit(buckets))
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("ship_id") == ship_id)).drop("bucket")


def scan_csv_typed(spark: SparkSession, path: str, schema: T.StructType, use: list[str] | None = None) -> DataFrame:
    """CSV with a declared schema; unread columns are pruned by the reader."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*use) if use else df


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def sink_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, by folders of ``partition_by`` where given.

    A task keeps up to OPEN_WRITERS folders open, so rows of few folders are not sorted before the write; with more
    folders Spark sorts the rest.
    """
    if not partition_by:
        df.write.parquet(path)
        return
    with setting(df.sparkSession, WRITERS, str(OPEN_WRITERS)):
        df.write.partitionBy(*partition_by).parquet(path)


def scan_register(df: DataFrame) -> DataFrame:
    """Register columns under pipeline names, typed."""
    named = df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})
    numeric = [c for c in REGISTER_NUMERIC + REGISTER_OPTIONAL if c in named.columns]
    return named.withColumns({"ship_id": F.col("ship_id").cast("long"), **{c: F.col(c).cast("double") for c in numeric}})


def scan_register_xml(spark: SparkSession, path: str, row_tag: str = "ship") -> DataFrame:
    """Ship documents with one child element per field; ``wni_ship_num`` becomes ``ship_id``, ``bhp`` ``power_at_mcr``.

    A document that has no ``wni_ship_num`` is named by its ``ship_id``. ``date_built`` is kept as text, with its
    year as ``date_built_year``. Text that is not a number gives NULL.
    """
    raw = spark.read.format("xml").schema(REGISTER_XML_SCHEMA).option("rowTag", row_tag).load(path)
    named = raw.withColumn("wni_ship_num", F.coalesce("wni_ship_num", "ship_id")).drop("ship_id")
    named = named.withColumnsRenamed(RENAMES).withColumn(
        "date_built_year", F.regexp_extract("date_built", "([0-9]{4})", 1)
    )
    numeric = [c for c in REGISTER_NUMERIC + REGISTER_OPTIONAL if c in named.columns]
    return named.select(
        F.col("ship_id").try_cast("long").alias("ship_id"),
        "ship_type",
        "date_built",
        *[F.col(c).try_cast("double").alias(c) for c in numeric],
    )
