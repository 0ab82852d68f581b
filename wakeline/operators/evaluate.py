"""Prediction tables and their error metrics. Every metric is one map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import normal
from ..functions.performance import denorm_speed
from ..session import stage
from .quantiles import HOT_ROWS, grouped_quantiles, value_bins
from .sized import attach, null_safe_join

METRICS = ["mae", "rmse", "mape", "r2"]


def error_aggs(y: str, p: str, metrics: list[str] = METRICS) -> list[Column]:
    """MAE, RMSE, MAPE (percent, zero actuals skipped) and R2 = 1 - SSres / SStot."""
    actual, pred = F.col(y), F.col(p)
    miss = actual - pred
    known = {
        "mae": F.avg(F.abs(miss)),
        "rmse": F.sqrt(F.avg(miss * miss)),
        "mape": F.avg(F.abs(F.try_divide(miss, actual))) * 100,
        "r2": F.lit(1.0) - F.try_divide(F.avg(miss * miss), F.var_pop(actual)),
    }
    return [known[m].alias(m) for m in metrics]


def metrics(df: DataFrame, by: list[str], y: str, p: str, which: list[str] = METRICS) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *error_aggs(y, p, which))


def metrics_by_run(df: DataFrame, y: str = "tw_speed", p: str = "pred_tw_speed") -> DataFrame:
    return metrics(df, ["type", "record_index"], y, p, ["mae", "rmse", "mape"])


def metrics_long(by_run: DataFrame, which: list[str] = ("mae", "rmse", "mape")) -> DataFrame:
    return by_run.unpivot(["type", "record_index"], list(which), "metric", "error")


def box_stats(long: DataFrame) -> DataFrame:
    """Five-number summary per split and metric."""
    q = grouped_quantiles(long, ["type", "metric"], "error", [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(
        "type",
        "metric",
        *[F.col("quantiles")[i].alias(n) for i, n in enumerate(["low", "q1", "median", "q3", "high"])],
    )


def metrics_by_class(df: DataFrame, classes: DataFrame, y: str = "tw_speed", p: str = "pred_tw_speed") -> DataFrame:
    """Test-split errors per ship class."""
    tested = df.where(F.col("type") == "test").join(classes.select("ship_id", "label"), "ship_id", "left")
    return metrics(tested, ["label"], y, p)


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(p)).withColumn(
        "error", F.try_divide(F.col(y) - F.col(p), F.col(y))
    ).withColumn("abs_error", F.abs("error"))


def assemble_results(df: DataFrame, register: DataFrame, pred: str = "pred_normalized_tw_speed") -> DataFrame:
    """Prediction table in natural units: ratings joined, speed through water and over ground rebuilt."""
    rated = df.join(register.select("ship_id", "rpm_at_mcr", "speed_at_mcr"), "ship_id", "left")
    return rated.withColumn("pred_tw_speed", denorm_speed(pred)).withColumn(
        "pred_og_speed", F.col("pred_tw_speed") + F.col("crnt_L")
    )


def rank_table(df: DataFrame, by: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct values per group with their frequency, the rows below them and the rows of the group.

    Ranks run per (group, value bin) with offsets from a table of bins; groups of very many distinct
    values are cut into bins, so none is ranked in one task.
    """
    freq = stage(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_rows")), "frequencies")
    binned = stage(value_bins(freq, by, value, hot_rows), "binned")
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        binned.groupBy(*by, "_bin")
        .agg(F.sum("n_rows").alias("_n"))
        .select(
            *by,
            "_bin",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            F.sum("_n").over(Window.partitionBy(*by)).alias("n_total"),
        )
    )
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = binned.withColumn("_in", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
    ranked = null_safe_join(local, bins, [*by, "_bin"])
    return ranked.select(*by, value, "n_rows", (F.col("_off") + F.col("_in")).alias("n_below"), "n_total")


def percent_rank_table(df: DataFrame, by: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct values per group with their frequency and percent rank: the points of a QQ plot."""
    ranked = rank_table(df, by, value, hot_rows)
    return ranked.select(*by, value, "n_rows", F.try_divide(F.col("n_below"), F.col("n_total") - 1).alias("pct_rank"))


def normal_quantile_table(df: DataFrame, by: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The points of a normal QQ plot with a fitted 45-degree line, equal values once.

    The i-th of n rows stands at the normal quantile of i / (n + 1); rows of one value reach from ``normal_low`` to
    ``normal_high``. ``standardised`` is the value by the mean and population deviation of its group.
    """
    known = df.where(F.col(value).isNotNull())
    fitted = known.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    placed = attach(rank_table(known, by, value, hot_rows), fitted, by)
    at = lambda i: normal.quantile(i / (F.col("n_total") + 1))
    return placed.select(
        *by,
        value,
        "n_rows",
        at(F.col("n_below") + 1).alias("normal_low"),
        at(F.col("n_below") + F.col("n_rows")).alias("normal_high"),
        F.try_divide(F.col(value) - F.col("_m"), F.col("_s")).alias("standardised"),
    )


def error_segment(error: str | Column, cut: float = -0.25) -> Column:
    e = F.col(error) if isinstance(error, str) else error
    return F.when(e > cut, "above").when(e <= cut, "below")


def quality_band(mape: str = "mape", mae: str = "mae") -> Column:
    """good: 0.5 < MAPE < 2; bad: MAPE > 7.5; then by MAE: high above 1, moderate in (0.2, 0.5)."""
    m, a = F.col(mape), F.col(mae)
    return (
        F.when((m > 0.5) & (m < 2), "good")
        .when(m > 7.5, "bad")
        .when(a > 1, "high_mae")
        .when((a > 0.2) & (a < 0.5), "moderate_mae")
        .otherwise("other")
    )


def split_coverage(df: DataFrame) -> DataFrame:
    """Share of all runs that occur in each split."""
    runs = df.select("type", "record_index").distinct()
    total = df.agg(F.count_distinct("record_index").alias("n")).scalar()
    return runs.groupBy("type").agg(F.count(F.lit(1)).alias("n_runs")).withColumn(
        "share", F.try_divide(F.col("n_runs"), total)
    )
