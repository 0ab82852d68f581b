"""Exact quantiles by linear interpolation, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .sized import any_of, attach

# Above this many rows a group's values no longer go through one aggregation buffer.
HOT_ROWS = 1_000_000
ACCURACY = 10_000


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    col: str,
    probs: list[float],
    hot_rows: int = HOT_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group: keys and the array ``quantiles`` in the order of ``probs``.

    Ordinary groups use the exact ``percentile`` aggregate. For a hot group a mergeable sketch
    brackets each rank; only values inside the bracket are ranked, and what lies below is counted.
    """
    valued = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    sizes = stage(valued.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    plist = F.array(*[F.lit(float(p)) for p in probs])
    exact = F.percentile("_v", plist).alias("quantiles")
    hot = sizes.where(F.col("_n") > hot_rows)
    if hot.isEmpty():
        return valued.groupBy(*keys).agg(exact)
    if not keys:
        return _bracketed(valued, keys, hot, probs, accuracy)
    cold = attach(valued, hot.select(*keys), keys, "left_anti").groupBy(*keys).agg(exact)
    return cold.unionByName(_bracketed(attach(valued, hot.select(*keys), keys, "left_semi"), keys, hot, probs, accuracy))


def _bracketed(valued: DataFrame, keys: list[str], sizes: DataFrame, probs: list[float], accuracy: int) -> DataFrame:
    margin = 2.0 / accuracy
    ends = [p for q in probs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = valued.groupBy(*keys).agg(
        F.percentile_approx("_v", [float(e) for e in ends], accuracy).alias("_ends"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    targets = []
    for i, q in enumerate(probs):
        lo = F.col("_min") if q - margin <= 0 else F.col("_ends")[2 * i]
        hi = F.col("_max") if q + margin >= 1 else F.col("_ends")[2 * i + 1]
        targets.append(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("p"), lo.alias("lo"), hi.alias("hi")))
    # one row per (group, probability), known to be few per group
    wanted = stage(sketch.select(*keys, F.explode(F.array(*targets)).alias("_t")).select(*keys, "_t.*"), "brackets")
    per_group = wanted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "p", "lo", "hi"))).alias("_t"))
    joined = attach(valued, per_group, keys) if keys else valued.withColumn("_t", _only(per_group))
    # Each value either lies below bracket i, inside it, or above; equal values collapse before the shuffle.
    below = joined.groupBy(*keys).agg(
        *[F.count_if(F.col("_v") < F.col("_t")[i]["lo"]).alias(f"_below{i}") for i in range(len(probs))],
        F.count(F.lit(1)).alias("_n"),
        F.first("_t").alias("_t"),
    )
    inside = (
        joined.where(any_of([F.col("_v").between(F.col("_t")[i]["lo"], F.col("_t")[i]["hi"]) for i in range(len(probs))]))
        .groupBy(*keys, "_v", "_t")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_v", "_c", F.explode("_t").alias("_b"))
        .where(F.col("_v").between(F.col("_b.lo"), F.col("_b.hi")))
        .select(*keys, "_v", "_c", F.col("_b.i").alias("i"))
    )
    base = below.select(
        *keys,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        F.col(f"_below{i}").alias("below"),
                        F.lit(float(q)).alias("p"),
                    )
                    for i, q in enumerate(probs)
                ]
            )
        ).alias("_x"),
    ).select(*keys, "_n", F.col("_x.i").alias("i"), F.col("_x.below").alias("below"), F.col("_x.p").alias("p"))
    base = base.withColumn("_pos", F.col("p") * (F.col("_n") - 1)).withColumn("_r", F.floor("_pos"))
    up_to = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.join(base, [*keys, "i"]).withColumn(
        "_from", F.col("below") + F.coalesce(F.sum("_c").over(up_to), F.lit(0))
    )

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c")), F.col("_v")))

    found = ranked.groupBy(*keys, "i").agg(
        at(F.col("_r")).alias("_lo"),
        at(F.least(F.col("_r") + 1, F.col("_n") - 1)).alias("_hi"),
        F.max(F.col("_pos") - F.col("_r")).alias("_w"),
    )
    value = F.when(
        F.col("_lo").isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("rank outside its bracket"))
    ).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w"))
    return (
        found.select(*keys, "i", value.cast("double").alias("_q"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("i", "_q"))).alias("_qs"))
        .select(*keys, F.col("_qs._q").alias("quantiles"))
    )


def _only(one_row: DataFrame):
    """The single value of a one-row, one-column table as a scalar subquery."""
    return one_row.scalar()


def value_bins(df: DataFrame, keys: list[str], col: str, hot_rows: int = HOT_ROWS, bins: int = 256) -> DataFrame:
    """Add ``_bin``, monotone in ``col``; only groups above ``hot_rows`` are cut, at sketch quantiles."""
    hot = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows), "hot-groups")
    if hot.isEmpty():
        return df.withColumn("_bin", F.lit(0).cast("long"))
    cuts = (
        attach(df.select(*keys, col), hot.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_distinct(F.percentile_approx(col, [i / bins for i in range(1, bins)], 8 * bins)).alias("_cuts"))
    )
    cut = attach(df, cuts, keys)
    position = F.size(F.filter("_cuts", lambda s: s < F.col(col)))
    return cut.withColumn("_bin", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(position).cast("long")).drop("_cuts")
