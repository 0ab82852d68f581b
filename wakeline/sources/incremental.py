"""Loading telemetry trees again and again, rewriting only the ship buckets whose files changed.

A manifest of all files (path, place of its tree, size, time) lies beside the table, one version a load. A load lists
the trees, compares the list with the last version and reads the files of touched buckets only, from every tree; their
rows replace the buckets' rows, whoever wrote them. A load that dies before its manifest is written is repeated by
the next one with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.clean import keep_first
from ..schema import LEG_SCHEMA
from ..session import stage
from .files import file_tasks, list_tree, path_id, scan_legs

BUCKETS = 256
PART_BYTES = 32 << 20  # of files whose rows a task sorts and writes at once
MANIFEST = "path string, source_rank int, ship_id long, bucket int, length long, modified timestamp"


def bucket_of(ship: str = "ship_id", buckets: int = BUCKETS):
    """The bucket ``columnar_checkpoint`` gives a ship."""
    return F.pmod(F.hash(F.col(ship).cast("long")), F.lit(buckets))


def file_manifest(spark: SparkSession, roots: list[str], file_glob: str, id_level: int = 4, buckets: int = BUCKETS) -> DataFrame:
    """One row for each matching file below the roots; contents are not read."""
    parts = []
    for rank, root in enumerate(roots):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", file_glob)
        found = list_tree(spark, lambda: reader.load(root))
        parts.append(found.select("path", F.lit(rank).alias("source_rank"), path_id(id_level, "path").alias("ship_id"), "length", "modificationTime"))
    return reduce(DataFrame.unionByName, parts).coalesce(file_tasks(spark)).select(
        "path", "source_rank", "ship_id", bucket_of(buckets=buckets).alias("bucket"), "length", F.col("modificationTime").alias("modified")
    )


def _last_manifest(spark: SparkSession, table: str) -> tuple[int, DataFrame]:
    schema = T.StructType.fromDDL(f"{MANIFEST}, version int")
    if not _exists(spark, f"{table}-manifest"):
        return 0, spark.createDataFrame([], MANIFEST)
    versions = spark.read.schema(schema).parquet(f"{table}-manifest")
    last = versions.agg(F.max("version")).first()[0] or 0
    return last, versions.where(F.col("version") == last).drop("version")


def manifest_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are added, changed (size, time or place of the tree) or removed."""
    facts = ["source_rank", "ship_id", "bucket", "length", "modified"]
    a = now.select("path", F.struct(*facts).alias("new"))
    b = before.select("path", F.struct(*facts).alias("old"))
    both = a.join(b, "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed")
    told = both.withColumn("change", change).where("change IS NOT NULL")
    return told.select("change", "path", F.coalesce("new", "old").alias("f")).select("change", "path", "f.source_rank", "f.ship_id", "f.bucket")


def load_trees(
    spark: SparkSession,
    roots: list[str],
    table: str,
    file_glob: str = "leg.json",
    multi_line: bool = True,
    schema: T.StructType = LEG_SCHEMA,
    key: tuple[str, ...] = ("ship_id", "client", "utc"),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Bring ``table`` (parquet by ship bucket) up to date with the trees; the changed files, one row each.

    Rows of one ``key`` are kept once, from the tree that comes first in ``roots``. The first load writes all buckets;
    a later one lists every file but reads and rewrites only buckets with a changed file. Buckets that lose all rows
    are removed. Files that did not change are never opened unless their bucket did.
    """
    now = stage(file_manifest(spark, roots, file_glob, buckets=buckets), "manifest")
    version, before = _last_manifest(spark, table)
    changes = stage(manifest_changes(now, before), "changes")
    touched = sorted(r[0] for r in changes.where("bucket IS NOT NULL").select("bucket").distinct().collect())
    if touched:
        # the bucket follows from the file's path, so files of other buckets are left out of the scan
        legs = scan_legs(spark, roots, file_glob, multi_line, schema).withColumn("bucket", bucket_of(buckets=buckets))
        sizes = dict(now.where(F.col("bucket").isin(touched)).groupBy("bucket").agg(F.sum("length")).collect())
        # rows meet by bucket, the unit of the write, and by parts of those whose files are large
        parts = F.lit([1 + sizes.get(b, 0) // PART_BYTES for b in range(buckets)])[F.col("bucket")]
        legs = legs.where(F.col("bucket").isin(touched)).withColumn("_part", F.pmod(F.xxhash64(*key), parts))
        rows = keep_first(legs, ["bucket", "_part", *key], rank=["source_rank"], meet=["bucket", "_part"]).drop("_part")
        seen = Observation()
        rows = rows.observe(seen, F.collect_set("bucket").alias("buckets"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        for bucket in set(touched) - set(seen.get["buckets"]):
            _remove(spark, f"{table}/bucket={bucket}")
    if touched or not version:
        now.withColumn("version", F.lit(version + 1)).write.mode("append").partitionBy("version").parquet(f"{table}-manifest")
    return changes


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
