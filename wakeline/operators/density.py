"""Kernel density tables of one and two columns per group.

Rows are laid on a grid by linear binning: each row gives its weight to the grid points next to it, so one aggregate
with map-side sums leaves at most a grid for each group, however many rows it has. The Gaussian kernel is then summed
over grids only, one axis after the other. Bandwidths follow Scott's rule from the group's moments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .sized import all_of, attach

CUT = 3.0  # bandwidths that the grid reaches beyond the extremes


def _axis(df: DataFrame, by: list[str], cols: list[str], grid: int) -> DataFrame:
    """Per group: rows, and for each column bandwidth, first grid point and step; groups without spread drop out."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"), F.stddev_samp(c).alias(f"_sd{i}")]
    out = df.groupBy(*by).agg(*aggs)
    power = -1.0 / (len(cols) + 4)
    keep = [*by, "_n"]
    for i in range(len(cols)):
        h = F.col(f"_sd{i}") * F.pow(F.col("_n").cast("double"), F.lit(power))
        out = out.withColumn(f"_h{i}", h).where(f"_h{i} > 0")
        first = F.col(f"_lo{i}") - F.lit(CUT) * F.col(f"_h{i}")
        out = out.withColumn(f"_x{i}", first)
        step = (F.col(f"_hi{i}") + F.lit(CUT) * F.col(f"_h{i}") - F.col(f"_x{i}")) / F.lit(float(grid - 1))
        out = out.withColumn(f"_d{i}", step)
        keep += [f"_h{i}", f"_x{i}", f"_d{i}"]
    return out.select(*keep)


def _near(place: Column, side: int) -> Column:
    """Weight of a row for the grid point left (0) or right (1) of it."""
    part = place - F.floor(place)
    return part if side else F.lit(1.0) - part


def _kernel(i: int, bin_: str, point: str) -> Column:
    """Normal kernel between two grid points of axis ``i``."""
    z = (F.col(point) - F.col(bin_)) * F.col(f"_d{i}") / F.col(f"_h{i}")
    return F.exp(F.lit(-0.5) * z * z) / (F.col(f"_h{i}") * F.lit(math.sqrt(2 * math.pi)))


def densities(df: DataFrame, by: list[str], cols: list[str], grid: int = 100) -> DataFrame:
    """``by``, one grid coordinate for each of the one or two ``cols``, and ``density`` at that point.

    Rows with a NULL or NaN in a column are left out; groups with fewer than two different values in a column have no
    density. The grid reaches three bandwidths beyond the extremes.
    """
    if len(cols) not in (1, 2):
        raise ValueError("one or two columns")
    numbers = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = numbers.where(all_of([F.col(c).isNotNull() & ~F.isnan(c) for c in cols]))
    axis = _axis(rows, by, cols, grid)
    placed = attach(rows, axis, by, "inner")
    places = [(F.col(c) - F.col(f"_x{i}")) / F.col(f"_d{i}") for i, c in enumerate(cols)]
    corners = [()]
    for _ in cols:
        corners = [(*k, side) for k in corners for side in (0, 1)]
    parts = []
    for corner in corners:
        weight = F.lit(1.0)
        for place, side in zip(places, corner):
            weight = weight * _near(place, side)
        bins = [(F.floor(place) + side).cast("int").alias(f"_b{i}") for i, (place, side) in enumerate(zip(places, corner))]
        parts.append(F.struct(*bins, weight.alias("_w")))
    keep = [c for c in axis.columns if c not in by]
    # the axis columns are the same for all rows of a group
    laid = placed.select(*by, *keep, F.inline(F.array(*parts)))
    names = [f"_b{i}" for i in range(len(cols))]
    binned = laid.groupBy(*by, *names).agg(F.sum("_w").alias("_w"), *[F.first(c).alias(c) for c in keep]).where("_w > 0")
    for i in range(len(cols)):
        point = f"_g{i}"
        spread = binned.withColumn(point, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        spread = spread.withColumn("_w", F.col("_w") * _kernel(i, f"_b{i}", point))
        left = [n for n in names[i + 1 :]] + [f"_g{j}" for j in range(i + 1)]
        binned = spread.groupBy(*by, *left).agg(F.sum("_w").alias("_w"), *[F.first(c).alias(c) for c in keep])
    at = [(F.col(f"_x{i}") + F.col(f"_g{i}") * F.col(f"_d{i}")).alias(c) for i, c in enumerate(cols)]
    return binned.select(*by, *[F.col(f"_g{i}").alias(f"i_{c}") for i, c in enumerate(cols)], *at, (F.col("_w") / F.col("_n")).alias("density"))
