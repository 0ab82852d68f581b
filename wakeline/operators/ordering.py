"""Positions and neighbours in long ordered groups.

A window over one ship's whole history would run in a single task, and one ship may
own a large part of all rows. Here a group is first cut into buckets of the ordering
column; the row-level windows run per (group, bucket), and a table with one row per
(group, bucket) carries offsets and edge values across bucket borders. The two meet on the
very keys the rows are already partitioned by, so the rows are shuffled once.

Rows whose key is NULL belong to no group: they are kept, without position or neighbours
beyond their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sized import null_safe_join

BUCKET_HOURS = 24
_NO_BUCKET = -(2**62)


def micros(time: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    col = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(col.cast("timestamp"))


def time_bucket(time: str, hours: int = BUCKET_HOURS) -> Column:
    """Monotone bucket number; rows without a time get a bucket of their own."""
    width = hours * 3_600_000_000
    return F.coalesce(F.floor(micros(time) / F.lit(width)), F.lit(_NO_BUCKET)).cast("long")


def group_offsets(sizes: DataFrame, keys: list[str], value: str, out: str, block: int = 1024) -> DataFrame:
    """Exclusive running total of ``value`` over the groups in key order.

    Two levels: blocks of the leading integer key are totalled first, so the only
    unpartitioned window sees one row per ``block`` ids.
    """
    lead = keys[0]
    blocked = sizes.withColumn("_blk", F.floor(F.col(lead) / F.lit(block)))
    before = Window.orderBy(F.col("_blk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_blk").agg(F.sum(value).alias("_tot")).select(
        "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy("_blk")
        .orderBy(*[F.col(k).asc_nulls_first() for k in keys])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return null_safe_join(local, blocks, ["_blk"]).withColumn(out, F.col("_base") + F.col("_in")).drop(
        "_blk", "_base", "_in"
    )


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    position: str = "position",
    size: str = "group_size",
) -> DataFrame:
    """1-based position of each row in its group and the group size.

    ``bucket`` must be monotone in the leading order column.
    """
    cut = df.withColumn("_b", bucket)
    local = cut.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*[F.col(c) for c in order]))
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        cut.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_b",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias(size),
        )
    )
    return local.join(counts, [*keys, "_b"], "left").select(
        *df.columns, (F.col("_off") + F.col("_rn")).alias(position), size
    )


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    time: str,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """Add values of the previous / following row of the group, ordered by ``time``.

    ``previous`` and ``following`` map an output name to a source column.
    """
    previous, following = previous or {}, following or {}
    cut = df.withColumn("_b", time_bucket(time, bucket_hours))
    row = Window.partitionBy(*keys, "_b").orderBy(time)
    first = F.min_by(F.struct(*[F.col(c).alias(o) for o, c in following.items()]), F.col(time))
    last = F.max_by(F.struct(*[F.col(c).alias(o) for o, c in previous.items()]), F.col(time))
    edge_aggs = ([first.alias("_first")] if following else []) + ([last.alias("_last")] if previous else [])
    across = Window.partitionBy(*keys).orderBy("_b")
    edges = cut.groupBy(*keys, "_b").agg(*edge_aggs, F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    carried = [F.col(k) for k in [*keys, "_b", "_t0", "_t1"]]
    if previous:
        carried.append(F.lag("_last").over(across).alias("_before"))
    if following:
        carried.append(F.lead("_first").over(across).alias("_after"))
    edges = edges.select(*carried)
    local = cut.withColumn("_i", F.row_number().over(row)).withColumn(
        "_m", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_b"))
    )
    for out, source in previous.items():
        local = local.withColumn(f"_p_{out}", F.lag(source).over(row))
    for out, source in following.items():
        local = local.withColumn(f"_f_{out}", F.lead(source).over(row))
    joined = local.join(edges, [*keys, "_b"], "left")
    outputs = [F.col(c) for c in df.columns]
    for out in previous:
        outputs.append(F.when(F.col("_i") > 1, F.col(f"_p_{out}")).otherwise(F.col(f"_before.{out}")).alias(out))
    for out in following:
        outputs.append(
            F.when(F.col("_i") < F.col("_m"), F.col(f"_f_{out}")).otherwise(F.col(f"_after.{out}")).alias(out)
        )
    return joined.select(*outputs)
