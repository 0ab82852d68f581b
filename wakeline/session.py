"""Session set-up and the shared stage folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_STAGE: str | None = None
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "wakeline", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": os.environ.get("WAKELINE_SHUFFLE", "8"),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # small inputs: keep all cores busy instead of folding shuffles into one task
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir`` where the session names one.

    A machine-local folder is used only by local sessions without that setting;
    on a cluster executors could not read it back, so that case is an error.
    """
    global _LOCAL_STAGE
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        # one folder per application, to be removed when the application is done
        return f"{shared.rstrip('/')}/wakeline/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _LOCAL_STAGE is None:
        _LOCAL_STAGE = tempfile.mkdtemp(prefix="wakeline-")
        atexit.register(shutil.rmtree, _LOCAL_STAGE, ignore_errors=True)
    return _LOCAL_STAGE


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the stage folder."""
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting while the block runs; the former one after it."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet stage table and return the table.

    Cuts lineage, survives lost executors, and gives the planner true file sizes. The write's shuffles go with it;
    by default they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with setting(spark, DROP_SHUFFLES, "true"):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of stage tables that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
