"""Data-quality reports: counts, shares and distributions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .quantiles import grouped_quantiles


def count_by(df: DataFrame, cols: list[str], out: str = "n_rows") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def group_size_stats(df: DataFrame, key: str = "ship_id") -> DataFrame:
    """Mean, median and minimum of the rows per key."""
    sizes = count_by(df, [key])
    # sizes repeat, so the exact median works on (size, how often)
    return count_by(sizes, ["n_rows"], "_f").agg(
        (F.sum(F.col("n_rows") * F.col("_f")) / F.sum("_f")).alias("mean_rows"),
        F.percentile("n_rows", F.lit(0.5), F.col("_f")).alias("median_rows"),
        F.min("n_rows").alias("min_rows"),
    )


def dup_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur once, twice, ..."""
    return count_by(count_by(df, keys, "multiplicity"), ["multiplicity"], "n_keys")


def share_per_column(df: DataFrame, tests: dict[str, Column], out: str = "share", scale: float = 100.0) -> DataFrame:
    """Tall table (column_name, share) of the rows for which each column's test holds."""
    one = df.agg(*[(F.count_if(t) / F.count(F.lit(1)) * scale).alias(c) for c, t in tests.items()])
    return one.unpivot([], list(tests), "column_name", out)


def missing_ratio(df: DataFrame, cols: list[str], limit: float = 9000.0, code: float = 9999.0) -> DataFrame:
    """Per column, in one pass: percentage of rows at or above ``limit``, and of rows with the exact ``code``."""
    n = F.count(F.lit(1))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.count_if(F.col(c) >= limit) / n * 100.0).alias("missing_pct"),
            (F.count_if(F.col(c) == code) / n * 100.0).alias("coded_pct"),
        )
        for c in cols
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count(F.lit(1)).alias("_n"))
    return one.unpivot(["_n"], cols, "column_name", "n_null").select(
        "column_name", "n_null", F.try_divide(F.col("n_null"), F.col("_n")).alias("null_share")
    )


def ratio_per_ship(df: DataFrame, lost: Column, out: str = "lost_pct", key: str = "ship_id") -> DataFrame:
    """Percentage of each ship's rows that ``lost`` marks, with its row count."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count_if(lost) / F.count(F.lit(1)) * 100).alias(out)
    )


def dup_ratio_per_ship(df: DataFrame, keys: list[str], key: str = "ship_id") -> DataFrame:
    """Percentage of each ship's rows that repeat an earlier (ship, time)."""
    per_key = count_by(df, keys, "_n")
    return per_key.groupBy(key).agg(
        F.sum("_n").alias("n_rows"),
        ((F.sum("_n") - F.count(F.lit(1))) / F.sum("_n") * 100).alias("dup_pct"),
    )


def retention(before: DataFrame, after: DataFrame, key: str = "ship_id") -> DataFrame:
    """Rows per ship before and after a step; ships lost entirely stay with 0."""
    b, a = count_by(before, [key], "rows_before"), count_by(after, [key], "rows_after")
    return b.join(a, key, "full").select(
        key,
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
        F.try_divide(F.coalesce("rows_after", F.lit(0)), F.col("rows_before")).alias("retained"),
    )


def min_max(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Tall table (column_name, low, high), optionally per group."""
    by = by or []
    one = df.groupBy(*by).agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in cols])
    tall = one.unpivot(by, cols, "column_name", "_mm")
    return tall.select(*by, "column_name", "_mm.low", "_mm.high")


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Counts in ``bins`` equal-width bins between minimum and maximum; the last bin is closed.

    A constant column is binned on a span of one unit around its value.
    """
    value = F.col(col).cast("double")
    half = F.when(F.min(value) == F.max(value), F.lit(0.5)).otherwise(F.lit(0.0))
    span = df.agg(F.struct((F.min(value) - half).alias("lo"), (F.max(value) + half).alias("hi"))).scalar()
    held = df.where(F.col(col).isNotNull()).select(value.alias("_v"), span.alias("_s"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    raw = F.floor((F.col("_v") - F.col("_s.lo")) / width)
    return (
        held.withColumn("bin", F.least(raw, F.lit(bins - 1).cast("long")))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def corr_matrix(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Pearson correlation of every column pair per group, as a tall symmetric table; NULL where a column is constant."""
    pairs = list(combinations(cols, 2))

    def corr(a: str, b: str) -> Column:
        # corr() raises on constant columns; each deviation is over the rows that have both
        dev = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
        return F.try_divide(F.covar_pop(a, b), dev(a, b) * dev(b, a))

    one = df.groupBy(*by).agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    tall = one.unpivot(by, [f"{a}|{b}" for a, b in pairs], "_pair", "corr")
    named = tall.select(
        *by, F.split("_pair", r"\|")[0].alias("col_a"), F.split("_pair", r"\|")[1].alias("col_b"), "corr"
    )
    return named.unionByName(named.select(*by, F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"))


def loss_audit(df: DataFrame, lost: Column) -> DataFrame:
    """Share of rows, runs and ships touched by a rule."""

    def share(c: str) -> Column:
        return F.try_divide(F.count_distinct(F.when(lost, F.col(c))), F.count_distinct(c))

    return df.agg(
        F.try_divide(F.count_if(lost), F.count(F.lit(1))).alias("row_share"),
        share("record_index").alias("run_share"),
        share("ship_id").alias("ship_share"),
    )


def stage_audit(steps: list[tuple[str, DataFrame]], rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows before and after each step.

    ``steps`` starts with the input and is counted table by table; ``rules`` are tests on the rows of the last
    step, each applied to the survivors of the ones before and all counted in one pass over it.
    """
    counts = [df.agg(F.array(F.count(F.lit(1))).alias("n")) for _, df in steps[:-1]]
    passed, tests = F.lit(True), []
    for _, rule in rules:
        passed = passed & F.coalesce(rule, F.lit(False))
        tests.append(F.count_if(passed))
    counts.append(steps[-1][1].agg(F.array(F.count(F.lit(1)), *tests).alias("n")))
    names = [name for name, _ in steps] + [name for name, _ in rules]
    tall = None
    for first, one in enumerate(counts):
        part = one.select(F.posexplode("n").alias("i", "n")).select((F.col("i") + first).alias("step_no"), "n")
        tall = part if tall is None else tall.unionByName(part)
    tall = tall.withColumn("step", F.element_at(F.array(*map(F.lit, names)), F.col("step_no") + 1))
    # a handful of rows, one per step
    before = tall.select((F.col("step_no") + 1).alias("step_no"), F.col("n").alias("rows_in"))
    return tall.join(before, "step_no").select("step_no", "step", "rows_in", F.col("n").alias("rows_out"))


def step_counts(
    head: list[tuple[str, DataFrame]], rules: list[tuple[str, Column]], tail: list[tuple[str, DataFrame]], key: str = "ship_id"
) -> DataFrame:
    """Rows and different keys before and after each step: tables, then tests on the last of them, then further tables.

    A table is counted in one aggregate; the tests, each on the survivors of the ones before, in one for all.
    """
    passed, tests = F.lit(True), []
    for _, rule in rules:
        passed = passed & F.coalesce(rule, F.lit(False))
        tests.append(F.struct(F.count_if(passed).alias("n"), F.count_distinct(F.when(passed, F.col(key))).alias("k")))
    whole = F.struct(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k"))
    counted = [df.agg(F.array(whole).alias("c")) for _, df in head]
    counted[-1] = head[-1][1].agg(F.array(whole, *tests).alias("c"))
    counted += [df.agg(F.array(whole).alias("c")) for _, df in tail]
    names = [name for name, _ in [*head, *rules, *tail]]
    starts = [*range(len(head)), *range(len(head) + len(rules), len(names))]
    parts = [one.select(F.posexplode("c").alias("i", "c")).select((F.col("i") + at).alias("step_no"), "c.n", "c.k") for at, one in zip(starts, counted)]
    tall = reduce(DataFrame.unionByName, parts).withColumn("step", F.element_at(F.array(*map(F.lit, names)), F.col("step_no") + 1))
    # a handful of rows, one per step
    tall = stage(tall, "step-counts")
    before = tall.select((F.col("step_no") + 1).alias("step_no"), F.col("n").alias("rows_in"), F.col("k").alias("ships_in"))
    return tall.join(before, "step_no").select("step_no", "step", "rows_in", F.col("n").alias("rows_out"), "ships_in", F.col("k").alias("ships_out"))


def quantile_row(df: DataFrame, col: str, probs: dict[str, float]) -> DataFrame:
    q = grouped_quantiles(df, [], col, list(probs.values()))
    return q.select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(probs)])
