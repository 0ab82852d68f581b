"""Row-level cleaning of telemetry and the register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import REGISTER_NUMERIC, WEATHER
from ..session import stage
from .quantiles import grouped_quantiles
from .sized import all_of, any_of, attach, null_safe_join

MIN_HISTORY = 1500
MISSING_FROM = 9000.0
MISSING_CODE = 9999.0
MIN_LOAD = 0.15
CHUNK = 10_000


def nan_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Spark orders NaN above every number; the pipeline knows only NULL."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def safe_numeric_cast(df: DataFrame, cols: list[str], to: str = "float") -> tuple[DataFrame, DataFrame]:
    """(rows whose text parses, rows that do not). NULL text is kept as NULL; 'nan' becomes NULL."""
    parsed = {c: F.trim(F.col(c)).try_cast(to) for c in cols}
    ok = all_of([F.col(c).isNull() | p.isNotNull() for c, p in parsed.items()])
    good = df.where(ok).withColumns({c: F.nanvl(p, F.lit(None).cast(to)) for c, p in parsed.items()})
    return good, df.where(~ok)


def keep_first(df: DataFrame, keys: list[str], rank: list[str] | None = None, meet: list[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``rank``, then by the remaining columns.

    Rows meet by key first and are sorted there: a sort ahead of the shuffle would hold, and spill, the whole
    input of a task. Copies of one key are sorted outside memory where they do not fit. With ``meet``, some of the
    keys, rows meet by those alone and come sorted by ``keys``.
    """
    rank = rank or []
    rest = rank + [c for c in df.columns if c not in keys and c not in rank]
    if not rest:
        return df.select(*keys).distinct()
    order = Window.partitionBy(*keys).orderBy(*rest)
    return df.repartition(*(meet or keys)).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def leading(df: DataFrame, keys: list[str], lead: str) -> DataFrame:
    """The rows with their key's smallest ``lead``, NULL before all values: those ``keep_first`` picks from if ``lead`` ranks first.

    For keys of many rows: only the smallest values are shuffled, and the planner broadcasts them where their file is
    small enough.
    """
    least = df.groupBy(*keys).agg(F.min(lead).alias("_least"), F.max(F.col(lead).isNull()).alias("_null"))
    least = least.select(*keys, F.when(~F.col("_null"), F.col("_least")).alias(lead))
    return null_safe_join(df, stage(least, "leading"), [*keys, lead], "left_semi")


def duplicate_rows(df: DataFrame, keys: list[str], rank: list[str] | None = None) -> DataFrame:
    """The rows ``keep_first`` rejects, each as often as it occurs.

    Only rows of repeated keys are looked at. Equal rows are counted first; the kept row of each
    key is looked up on all columns, so neither side has a heavy key. Counts are expanded in chunks
    spread over tasks.
    """
    cols = df.columns
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    suspects = attach(df, repeated, keys, "left_semi")
    counted = stage(suspects.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")), "counted-rows")
    kept = keep_first(counted.select(*cols), keys, rank).withColumn("_kept", F.lit(1))
    extra = null_safe_join(counted, kept, cols, "left").withColumn(
        "_n", F.col("_n") - F.coalesce(F.col("_kept"), F.lit(0))
    )
    chunks = extra.where("_n > 0").select(
        *cols, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))).alias("_c")
    )
    spread = chunks.repartition(F.col("_c"), *[F.col(c) for c in cols])
    inside = F.least(F.lit(CHUNK).cast("long"), F.col("_n") - F.col("_c") * CHUNK)
    return spread.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), inside)).alias("_i")).drop("_i")


def missing_eq(df: DataFrame, cols: list[str] = WEATHER, code: float = MISSING_CODE) -> DataFrame:
    """Drop rows with the exact sentinel in any of ``cols``; NULL is not a sentinel."""
    return df.where(~any_of([_true(F.col(c) == code) for c in cols]))


def no_missing_ge(cols: list[str] = WEATHER, limit: float = MISSING_FROM) -> Column:
    return ~any_of([_true(F.col(c) >= limit) for c in cols])


def missing_ge(df: DataFrame, cols: list[str] = WEATHER, limit: float = MISSING_FROM) -> DataFrame:
    return df.where(no_missing_ge(cols, limit))


def dir_nonneg_all(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(all_of([F.col(c) >= 0 for c in cols]))


def is_dir_positive(cols: list[str] = ("sea_dir", "swl_dir")) -> Column:
    return all_of([F.col(c) > 0 for c in cols])


def dir_positive(df: DataFrame, cols: list[str] = ("sea_dir", "swl_dir")) -> DataFrame:
    return df.where(is_dir_positive(cols))


def is_rated() -> Column:
    """Inside the ship's ratings; NULL where the ship has none."""
    return (
        (F.col("og_speed") > 0)
        & (F.col("og_speed") < F.col("speed_at_mcr"))
        & (F.col("rpm") > 0)
        & (F.col("rpm") < F.col("rpm_at_mcr"))
        & (F.col("draft_aft") < 1.5 * F.col("draft"))
        & (F.col("draft_fore") < 1.5 * F.col("draft"))
        & (F.col("foc_me") > 0)
    )


def rated_range(df: DataFrame) -> DataFrame:
    """Rows inside the ship's ratings; rows of ships without ratings drop out."""
    return df.where(is_rated())


def violation_counts(df: DataFrame) -> DataFrame:
    """Rows outside each rating. Not the complement of ``rated_range``: a value equal to its
    rating is no violation here, and negative drafts are."""

    def outside(c: str, rated: str) -> Column:
        return F.count_if((F.col(c) <= 0) | (F.col(c) > F.col(rated)))

    def deep(c: str) -> Column:
        return F.count_if((F.col(c) < 0) | (F.col(c) >= 1.5 * F.col("draft")))

    return df.agg(
        outside("og_speed", "speed_at_mcr").alias("bad_og_speed"),
        outside("rpm", "rpm_at_mcr").alias("bad_rpm"),
        deep("draft_aft").alias("bad_draft_aft"),
        deep("draft_fore").alias("bad_draft_fore"),
    )


def min_load(df: DataFrame, share: float = MIN_LOAD) -> DataFrame:
    return df.where(
        (F.col("og_speed") >= share * F.col("speed_at_mcr"))
        & (F.col("rpm") >= share * F.col("rpm_at_mcr"))
        & (F.col("foc_me") > 0)
    )


def long_history(df: DataFrame, at_least: int = MIN_HISTORY, key: str = "ship_id") -> DataFrame:
    """The keys with enough rows."""
    return df.groupBy(key).count().where(F.col("count") >= at_least).select(key)


def min_history(df: DataFrame, at_least: int = MIN_HISTORY, key: str = "ship_id") -> DataFrame:
    """Rows of keys with enough rows. Counting combines map-side; no window over a whole ship."""
    return attach(df, long_history(df, at_least, key), [key], "left_semi")


def quantile_trim(
    df: DataFrame, rules: list[tuple[str, float | None, float | None]], key: str = "ship_id"
) -> DataFrame:
    """Sequential per-ship quantile filters: each rule sees the survivors of the one before.

    A rule is (column, lower probability or None, upper probability or None), bounds inclusive.
    """
    for col, low, high in rules:
        probs = [p for p in (low, high) if p is not None]
        bounds = grouped_quantiles(df, [key], col, probs).select(
            key, *[F.col("quantiles")[i].alias(f"_q{i}") for i in range(len(probs))]
        )
        met = attach(df, bounds, [key], "inner")
        tests = []
        if low is not None:
            tests.append(F.col(col) >= F.col("_q0"))
        if high is not None:
            tests.append(F.col(col) <= F.col(f"_q{len(probs) - 1}"))
        df = met.where(all_of(tests)).select(*df.columns)
    return df


# The two trimming schemes.
TRIM_TAILS = [("og_speed", 0.03, None), ("foc_me", 0.03, 0.97), ("rpm", 0.02, None)]
TRIM_BOTH = [("og_speed", 0.02, 0.98), ("foc_me", 0.02, 0.98), ("rpm", 0.02, 0.98)]


def register_clean(register: DataFrame) -> DataFrame:
    """Register rows complete in their ids and ratings, with positive depth and power; other columns may be null."""
    needed = [c for c in ["ship_id", "ship_type", *REGISTER_NUMERIC] if c in register.columns]
    return register.na.drop(subset=needed).where("depth > 0 AND power_at_mcr > 0")


def join_ratings(df: DataFrame, register: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Ratings of the row's ship. The planner broadcasts the register only if its files are small
    enough; otherwise a sort-merge join whose hot partitions adaptive execution splits."""
    return df.join(register.select("ship_id", *cols), "ship_id", how)


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))
