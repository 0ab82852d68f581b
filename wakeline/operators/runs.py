"""Continuous runs: gaps, point classes, run numbering and run-level fuel rules.

Rows of one (ship, client) belong to the same run while consecutive timestamps are at
most ``gap`` hours apart. Rows without any neighbour that near, or with a NULL key, are isolated
and belong to no run. (keys, time) is unique: run the keep-first rule before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .ordering import BUCKET_HOURS, group_offsets, micros, time_bucket, with_neighbours
from .sized import attach, null_safe_join

KEYS = ["ship_id", "client"]
GAP_HOURS = 6
EDGE_HOURS = 100.0
MIN_RUN = 56
MIN_FUEL_SHARE = 0.15


def hours_between(earlier: Column, later: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def gap_hours(
    df: DataFrame, keys: list[str] = KEYS, time: str = "utc", edge: float = EDGE_HOURS, bucket_hours: int = BUCKET_HOURS
) -> DataFrame:
    """Add ``s1`` / ``s2``: hours since the previous and until the next row; ``edge`` at the ends."""
    near = with_neighbours(df, keys, time, {"_prev": time}, {"_next": time}, bucket_hours)
    return near.select(
        *df.columns,
        F.coalesce(hours_between(F.col("_prev"), F.col(time)), F.lit(edge)).alias("s1"),
        F.coalesce(hours_between(F.col(time), F.col("_next")), F.lit(edge)).alias("s2"),
    )


def class_of(s1: str | Column = "s1", s2: str | Column = "s2", gap: float = GAP_HOURS) -> Column:
    """isolated / start / end / inner from the two gaps; a gap of exactly ``gap`` still connects."""
    s1 = F.col(s1) if isinstance(s1, str) else s1
    s2 = F.col(s2) if isinstance(s2, str) else s2
    far_before, far_after = s1 > gap, s2 > gap
    return (
        F.when(far_before & far_after, "isolated")
        .when(far_before, "start")
        .when(far_after, "end")
        .otherwise("inner")
    )


def point_class(df: DataFrame, gap: float = GAP_HOURS, **kw) -> DataFrame:
    return gap_hours(df, **kw).withColumn("point_class", class_of(gap=gap))


def continuous_runs(
    df: DataFrame,
    keys: list[str] = KEYS,
    time: str = "utc",
    gap: float = GAP_HOURS,
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """Keep non-isolated rows; add ``record_length`` and the global 1-based ``record_index``.

    Index order is (keys, run start). Row-level windows run per (keys, time bucket).
    What crosses a bucket border (length of a chain that continues in other buckets, runs
    started earlier) comes from a table with at most one row per (keys, bucket).
    """
    limit = F.lit(gap)
    b = [*keys, "_b"]
    in_bucket = Window.partitionBy(*b).orderBy(time)
    so_far = in_bucket.rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        df.withColumn("_b", time_bucket(time, bucket_hours))
        .withColumn("_gap", hours_between(F.lag(time).over(in_bucket), F.col(time)))
        .withColumn("_break", F.coalesce((F.col("_gap") > limit).cast("int"), F.lit(0)))
        .withColumn("_chain", F.sum("_break").over(so_far))
    )
    with_len = cut.withColumn("_clen", F.count(F.lit(1)).over(Window.partitionBy(*b, "_chain")))

    # One row per (keys, bucket): its edge times, number of chains, lengths of the outer chains,
    # and the number of proper runs among the chains that touch neither border.
    summary = (
        with_len.groupBy(*b)
        .agg(
            F.min(time).alias("_t0"),
            F.max(time).alias("_t1"),
            F.max("_chain").alias("_last"),
            F.min_by("_clen", time).alias("_len0"),
            F.max_by("_clen", time).alias("_len1"),
            F.sum(
                F.when((F.col("_break") == 1) & (F.col("_clen") > 1), F.lit(1)).otherwise(F.lit(0))
            ).alias("_inner_heads"),
        )
        # heads counted above include the last chain, which may go on in the next bucket
        .withColumn(
            "_inner_heads",
            F.col("_inner_heads")
            - F.when((F.col("_last") > 0) & (F.col("_len1") > 1), F.lit(1)).otherwise(F.lit(0)),
        )
    )
    over_buckets = Window.partitionBy(*keys).orderBy("_b")
    linked = summary.withColumn(
        "_joins_prev",
        F.coalesce(hours_between(F.lag("_t1").over(over_buckets), F.col("_t0")) <= limit, F.lit(False)),
    )
    # A bucket contributes its first and (if different) its last chain as pieces; a piece opens a
    # new island unless it is a first chain that joins the previous bucket.
    pieces = linked.select(
        *b,
        F.explode(
            F.when(
                F.col("_last") > 0,
                F.array(
                    F.struct(F.lit(0).alias("pos"), F.col("_len0").alias("len"), (~F.col("_joins_prev")).alias("open")),
                    F.struct(F.lit(1).alias("pos"), F.col("_len1").alias("len"), F.lit(True).alias("open")),
                ),
            ).otherwise(
                F.array(
                    F.struct(F.lit(0).alias("pos"), F.col("_len0").alias("len"), (~F.col("_joins_prev")).alias("open"))
                )
            )
        ).alias("_p"),
        "_inner_heads",
    )
    piece_order = Window.partitionBy(*keys).orderBy("_b", "_p.pos")
    pieces = pieces.withColumn(
        "_island", F.sum(F.col("_p.open").cast("int")).over(piece_order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_total", F.sum("_p.len").over(Window.partitionBy(*keys, "_island")))
    per_bucket = pieces.groupBy(*b).agg(
        F.max(F.when(F.col("_p.pos") == 0, F.col("_total"))).alias("_tot0"),
        F.max(F.when(F.col("_p.pos") == 1, F.col("_total"))).alias("_tot1"),
        F.max(F.when(F.col("_p.pos") == 0, F.col("_p.open"))).alias("_open0"),
        F.sum((F.col("_p.open") & (F.col("_total") > 1)).cast("int")).alias("_outer_heads"),
        F.max("_inner_heads").alias("_inner_heads"),
    ).withColumn("_heads", F.col("_outer_heads") + F.col("_inner_heads"))
    # Read three times below; written once so that the rows are not windowed again for each use.
    per_bucket = stage(per_bucket, "run-buckets")
    per_group = per_bucket.groupBy(*keys).agg(F.sum("_heads").alias("_heads"))
    offsets = group_offsets(per_group, keys, "_heads", "_group_off").drop("_heads")
    earlier = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    carried = null_safe_join(
        per_bucket.withColumn("_off", F.coalesce(F.sum("_heads").over(earlier), F.lit(0))), offsets, keys
    ).select(*b, "_tot0", "_tot1", "_open0", (F.col("_off") + F.col("_group_off")).alias("_off"))

    # same keys as the windows above: the rows stay where they are
    rows = with_len.withColumn("_lastc", F.max("_chain").over(Window.partitionBy(*b))).join(carried, b)
    length = (
        F.when(F.col("_chain") == 0, F.col("_tot0"))
        .when(F.col("_chain") == F.col("_lastc"), F.col("_tot1"))
        .otherwise(F.col("_clen"))
    )
    first_in_bucket = F.lag(time).over(in_bucket).isNull()
    opens = (F.col("_break") == 1) | (first_in_bucket & F.col("_open0"))
    numbered = (
        rows.withColumn("record_length", length.cast("long"))
        .withColumn("_head", (opens & (F.col("record_length") > 1)).cast("int"))
        .withColumn("record_index", (F.col("_off") + F.sum("_head").over(so_far)).cast("long"))
    )
    return numbered.where("record_length > 1").select(*df.columns, "record_length", "record_index")


def min_run_length(df: DataFrame, length: int = MIN_RUN) -> DataFrame:
    return df.where(F.col("record_length") >= length)


def with_run_stats(
    df: DataFrame,
    partial: dict[str, Column],
    total: dict[str, Column],
    run: str = "record_index",
    time: str = "utc",
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """Attach aggregates of the whole run to each of its rows.

    ``partial`` aggregates the rows of one (run, time bucket), ``total`` merges those over the
    run. Rows meet the result on (run, bucket), so a run of any length is spread over its buckets.
    """
    cut = df.withColumn("_b", time_bucket(time, bucket_hours))
    part = cut.groupBy(run, "_b").agg(*[c.alias(n) for n, c in partial.items()])
    whole = Window.partitionBy(run)
    merged = part.select(run, "_b", *[c.over(whole).alias(f"_r_{n}") for n, c in total.items()])
    return (
        cut.join(merged, [run, "_b"])
        .select(*df.columns, *[F.col(f"_r_{n}").alias(n) for n in total])
    )


def low_fuel_flag(df: DataFrame, share: float = MIN_FUEL_SHARE, fuel: str = "foc_me", **kw) -> DataFrame:
    """Flag rows burning less than ``share`` of the run's maximum."""
    peak = with_run_stats(df, {"_peak": F.max(fuel)}, {"_peak": F.max("_peak")}, **kw)
    return peak.withColumn("foc_too_small", F.col(fuel) < F.lit(share) * F.col("_peak")).drop("_peak")


def drop_low_fuel_runs(df: DataFrame, share: float = MIN_FUEL_SHARE, fuel: str = "foc_me", **kw) -> DataFrame:
    """Drop every run with a flagged row: its minimum decides."""
    ends = with_run_stats(
        df,
        {"_peak": F.max(fuel), "_low": F.min(fuel)},
        {"_peak": F.max("_peak"), "_low": F.min("_low")},
        **kw,
    )
    flagged = F.coalesce(F.col("_low") < F.lit(share) * F.col("_peak"), F.lit(False))
    return ends.where(~flagged).drop("_peak", "_low")


def fuel_step_change(
    df: DataFrame,
    version: int = 2,
    fuel: str = "foc_me",
    run: str = "record_index",
    time: str = "utc",
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """Add ``foc_diff``, the relative change to the next row of the run; 0 at its end.

    Version 1 divides by (s + 1); version 2 divides by s and is in percent.
    """
    near = with_neighbours(df, [run], time, following={"_next": fuel}, bucket_hours=bucket_hours)
    step = F.col(fuel) - F.col("_next")
    change = (
        F.abs(F.try_divide(step, F.col(fuel) + F.lit(1.0)))
        if version == 1
        else F.abs(F.try_divide(step, F.col(fuel)) * F.lit(100.0))
    )
    return near.withColumn("foc_diff", F.coalesce(change, F.lit(0.0))).drop("_next")


def run_fuel_ok(df: DataFrame, share: float = MIN_FUEL_SHARE, max_change: float = 2.0, **kw) -> DataFrame:
    """Version 1 verdict: ``is_foc_ok`` is false for runs with a low row or a change above ``max_change``."""
    changed = fuel_step_change(df, version=1, **kw)
    run_kw = {k: v for k, v in kw.items() if k in ("run", "time", "bucket_hours")}
    fuel = kw.get("fuel", "foc_me")
    stats = with_run_stats(
        changed,
        {"_peak": F.max(fuel), "_low": F.min(fuel), "_step": F.max("foc_diff")},
        {"_peak": F.max("_peak"), "_low": F.min("_low"), "_step": F.max("_step")},
        **run_kw,
    )
    bad = (F.col("_low") < F.lit(share) * F.col("_peak")) | (F.col("_step") > F.lit(max_change))
    return stats.withColumn("is_foc_ok", ~F.coalesce(bad, F.lit(False))).drop("_peak", "_low", "_step")


def run_change_band(df: DataFrame, low: float = 1.0, high: float = 100.0, **kw) -> DataFrame:
    """Version 2 verdict: keep runs whose largest step change lies in [low, high] percent."""
    changed = fuel_step_change(df, version=2, **kw)
    run_kw = {k: v for k, v in kw.items() if k in ("run", "time", "bucket_hours")}
    stats = with_run_stats(changed, {"_step": F.max("foc_diff")}, {"_step": F.max("_step")}, **run_kw)
    return stats.where(F.col("_step").between(low, high)).drop("_step")


def run_table(df: DataFrame, run: str = "record_index", time: str = "utc") -> DataFrame:
    """One row per run: owner, first and last time, length."""
    return df.groupBy(run).agg(
        F.min("ship_id").alias("ship_id"),
        F.min("client").alias("client"),
        F.min(time).alias("start_utc"),
        F.max(time).alias("end_utc"),
        F.count(F.lit(1)).alias("record_length"),
    )


def drop_runs(df: DataFrame, bad: DataFrame, run: str = "record_index") -> DataFrame:
    """Remove all rows of the runs listed in ``bad``."""
    return attach(df, bad.select(run).distinct(), [run], "left_anti")


def point_class_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [
        F.count_if(F.col("point_class") == c).alias(f"n_{c}") for c in ("isolated", "start", "end", "inner")
    ]
    return (df.groupBy(*by) if by else df.groupBy()).agg(*counts, F.count(F.lit(1)).alias("n_rows"))


def run_length_stats(runs: DataFrame, long_run: int = 64) -> DataFrame:
    """Per ship: number of runs, how many reach ``long_run`` rows, shortest and longest."""
    return runs.groupBy("ship_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("record_length") >= long_run).alias("n_long"),
        F.min("record_length").alias("min_len"),
        F.max("record_length").alias("max_len"),
    )
