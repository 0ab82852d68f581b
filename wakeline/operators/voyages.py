"""Voyages: numbering, overlap check and labelling of telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .ordering import BUCKET_HOURS, group_offsets, micros, time_bucket, with_position
from .sized import attach, null_safe_join

VOYAGE_KEY = ["ship_id", "dep_utc", "arr_utc"]
# more voyages than this beginning or ending in one bucket of a ship cut the bucket into smaller ones
CROWDED = 64


def number_voyages(voyages: DataFrame, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Distinct voyages with ``rout_id`` 1..n in (ship, departure, arrival) order."""
    distinct = voyages.select(*VOYAGE_KEY).distinct()
    sizes = distinct.groupBy("ship_id").agg(F.count(F.lit(1)).alias("_n"))
    offsets = group_offsets(sizes, ["ship_id"], "_n", "_off").select("ship_id", "_off")
    placed = with_position(distinct, ["ship_id"], ["dep_utc", "arr_utc"], time_bucket("dep_utc", bucket_hours))
    return null_safe_join(placed, offsets, ["ship_id"]).select(
        *VOYAGE_KEY, (F.col("_off") + F.col("position")).cast("long").alias("rout_id")
    )


def alternation_violations(numbered: DataFrame, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Departure / arrival events that follow an event of the same kind on the same ship.

    Empty exactly when the voyages of every ship are strictly one after the other. Events at
    the same instant are ordered departure after arrival, then by voyage.
    """
    events = numbered.unpivot(["ship_id", "rout_id"], ["dep_utc", "arr_utc"], "variable", "utc")
    # one sortable column, as instants may tie
    order = F.struct("utc", "variable", "rout_id")
    cut = events.withColumn("_b", time_bucket("utc", bucket_hours)).withColumn("_o", order)
    inside = Window.partitionBy("ship_id", "_b").orderBy("_o")
    edges = (
        cut.groupBy("ship_id", "_b")
        .agg(F.max_by("variable", "_o").alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.partitionBy("ship_id").orderBy("_b")))
        .select("ship_id", "_b", "_before")
    )
    local = cut.withColumn("_rn", F.row_number().over(inside)).withColumn("_pv", F.lag("variable").over(inside))
    joined = local.join(edges, ["ship_id", "_b"])
    previous = F.when(F.col("_rn") > 1, F.col("_pv")).otherwise(F.col("_before"))
    expected = F.when(F.col("variable") == "dep_utc", "arr_utc").otherwise("dep_utc")
    return joined.where(F.coalesce(previous, F.lit("arr_utc")) != expected).select(
        "ship_id", "rout_id", "variable", "utc"
    )


def label_voyages(
    legs: DataFrame,
    numbered: DataFrame,
    time: str = "utc",
    bucket_hours: int = BUCKET_HOURS,
    crowded: int = CROWDED,
) -> DataFrame:
    """Add ``rout_id`` of the voyage covering the row's time, 0 outside; of overlapping voyages the largest id."""
    # The answer depends on (ship, time) only, so equal times are asked once.
    asked = legs.where(F.col(time).isNotNull()).select("ship_id", F.col(time).alias("_time")).distinct()
    asked = stage(asked.withColumn("_t", micros("_time")), "voyage-times")
    spans = stage(
        numbered.select("ship_id", micros("dep_utc").alias("_dep"), micros("arr_utc").alias("_arr"), "rout_id"), "voyage-spans"
    )
    best = _largest_cover(asked.select("ship_id", "_t"), spans, bucket_hours * 3_600_000_000, crowded)
    answers = asked.join(best, ["ship_id", "_t"]).select("ship_id", F.col("_time").alias(time), "rout_id")
    return attach(legs, answers, ["ship_id", time]).withColumn(
        "rout_id", F.coalesce("rout_id", F.lit(0).cast("long"))
    )


def _largest_cover(asked: DataFrame, spans: DataFrame, width: int, crowded: int) -> DataFrame:
    """(ship_id, _t, rout_id) for the times that some span [_dep, _arr] covers.

    A bucket that a span covers whole needs no comparison: one row per (ship, bucket) keeps the
    largest id. Times are compared with spans only where a span begins or ends inside the bucket;
    buckets where more than ``crowded`` do are cut again, down to single instants if need be.
    """
    w = F.lit(width)
    first_whole, last_whole = -F.floor(-F.col("_dep") / w), F.floor((F.col("_arr") + 1) / w) - 1
    placed = spans.where("_dep <= _arr").withColumns(
        {"_b0": F.floor(F.col("_dep") / w), "_b1": F.floor(F.col("_arr") / w), "_f0": first_whole, "_f1": last_whole}
    )
    whole = (
        placed.where("_f0 <= _f1")
        .select("ship_id", "rout_id", F.explode(F.sequence("_f0", "_f1")).alias("_b"))
        .groupBy("ship_id", "_b")
        .agg(F.max("rout_id").alias("_whole"))
    )
    touched = F.array_distinct(F.array(F.when(F.col("_b0") < F.col("_f0"), F.col("_b0")), F.when(F.col("_b1") > F.col("_f1"), F.col("_b1"))))
    ends = placed.select("ship_id", "_dep", "_arr", "rout_id", F.explode(touched).alias("_b")).where("_b IS NOT NULL")
    at = asked.withColumn("_b", F.floor(F.col("_t") / w))
    crowd = stage(ends.groupBy("ship_id", "_b").count().where(F.col("count") > crowded).select("ship_id", "_b"), "crowded")
    nested = None
    if not crowd.isEmpty():
        # clipped to their bucket, the spans of a crowded bucket fall into 24 smaller ones
        inner = attach(ends, crowd, ["ship_id", "_b"], "left_semi").select(
            "ship_id",
            F.greatest(F.col("_dep"), F.col("_b") * w).alias("_dep"),
            F.least(F.col("_arr"), (F.col("_b") + 1) * w - 1).alias("_arr"),
            "rout_id",
        )
        nested = _largest_cover(
            attach(at, crowd, ["ship_id", "_b"], "left_semi").select("ship_id", "_t"), stage(inner, "crowded-spans"), max(1, width // 24), crowded
        ).withColumnRenamed("rout_id", "_part")
        ends = attach(ends, crowd, ["ship_id", "_b"], "left_anti")
    part = (
        at.join(ends, ["ship_id", "_b"])
        .where(F.col("_t").between(F.col("_dep"), F.col("_arr")))
        .groupBy("ship_id", "_t")
        .agg(F.max("rout_id").alias("_part"))
    )
    if nested is not None:
        part = part.unionByName(nested)
    return (
        at.join(whole, ["ship_id", "_b"], "left")
        .join(part, ["ship_id", "_t"], "left")
        .select("ship_id", "_t", F.greatest("_whole", "_part").alias("rout_id"))
        .where(F.col("rout_id").isNotNull())
    )
