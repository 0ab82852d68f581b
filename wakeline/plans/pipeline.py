"""The three jobs: telemetry to records, register to classes, records to error reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import audit, classes, clean, evaluate, outliers, ridge, runs, scaling, splits
from ..operators.sized import all_of
from ..schema import FEATURES, RECORD, SCALED_FEATURES
from ..session import stage
from .features import feature_table, outlier_features


@dataclass(frozen=True)
class CleaningRules:
    """Canonical parameters; earlier variants of the job differ only in these."""

    min_rows: int = clean.MIN_HISTORY
    missing_from: float = clean.MISSING_FROM
    contamination: float = outliers.CONTAMINATION
    gap_hours: float = runs.GAP_HOURS
    min_run: int = runs.MIN_RUN
    low_fuel: float = runs.MIN_FUEL_SHARE
    change_band: tuple[float, float] = (1.0, 100.0)
    filter_history_first: bool = False
    dedup_key: tuple[str, ...] = ("ship_id", "client", "utc")
    bucket_hours: int = 24


def known_once(legs: DataFrame, register: DataFrame, rules: CleaningRules) -> tuple[DataFrame, DataFrame]:
    """Rows of known ships, and those without repeats."""
    known = legs.join(register.select("ship_id"), "ship_id", "left_semi")
    if rules.filter_history_first:
        known = clean.min_history(known, rules.min_rows)
    return known, clean.keep_first(known, list(rules.dedup_key))


def row_rules(rules: CleaningRules) -> list[tuple[str, Column]]:
    """The tests on single rows, in order; a row needs its ship's ratings beside it."""
    return [
        ("missing", clean.no_missing_ge(limit=rules.missing_from)),
        ("directions", clean.is_dir_positive()),
        ("ratings", clean.is_rated()),
    ]


def with_ratings(legs: DataFrame, register: DataFrame) -> DataFrame:
    return clean.join_ratings(legs, register, ["draft", "speed_at_mcr", "rpm_at_mcr"])


def clean_telemetry(legs: DataFrame, register: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Known ships, no repeats, no sentinels, proper directions, inside ratings, long enough history."""
    _, once = known_once(legs, register, rules)
    rated = with_ratings(once, register).where(all_of([rule for _, rule in row_rules(rules)]))
    # read twice by the history filter
    return clean.min_history(stage(rated.select(*legs.columns), "clean"), rules.min_rows)


def without_outliers(legs: DataFrame, register: DataFrame, rules: CleaningRules) -> DataFrame:
    """Rows that are no outliers. Rows without a score (no power rating, very short history) are none and stay."""
    base = stage(outlier_features(legs, register), "outlier-in")
    scored = stage(outliers.knn_score(base, ["norm_rpm3", "norm_foc_me", "norm_tw_speed"]), "outlier-scores")
    kept = outliers.outlier_label(scored, contamination=rules.contamination).where("coalesce(outlier_label, 0) = 0")
    return stage(kept.select(*legs.columns), "outlier-out")


def drop_outliers(legs: DataFrame, register: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """``without_outliers``, then ships with enough rows left."""
    return clean.min_history(without_outliers(legs, register, rules), rules.min_rows)


def run_steps(legs: DataFrame, rules: CleaningRules = CleaningRules()) -> list[tuple[str, DataFrame]]:
    """What each run rule leaves; every one but the last is a stage table."""
    hours = {"bucket_hours": rules.bucket_hours}
    found = stage(runs.continuous_runs(legs, gap=rules.gap_hours, **hours), "runs")
    long_enough = runs.min_run_length(found, rules.min_run)
    burning = stage(runs.drop_low_fuel_runs(long_enough, rules.low_fuel, **hours), "runs-fuel")
    banded = runs.run_change_band(burning, *rules.change_band, **hours)
    return [("connected", found), ("run_length", long_enough), ("low_fuel", burning), ("change_band", banded)]


def continuous_records(legs: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Rows of usable continuous runs with run length and index."""
    banded = run_steps(legs, rules)[-1][1]
    return banded.select(*[c for c in RECORD if c in banded.columns])


def telemetry_to_records(legs: DataFrame, register: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    cleaned = stage(clean_telemetry(legs, register, rules), "legs-clean")
    kept = stage(drop_outliers(cleaned, register, rules), "legs-kept")
    return continuous_records(kept, rules)


def job_audit(legs: DataFrame, register: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Rows and ships before and after every step of ``telemetry_to_records``.

    Single-row tests are counted together in one pass; the other steps are counted on the tables the job writes.
    """
    known, once = known_once(legs, register, rules)
    base = stage(with_ratings(once, register), "audit-once")
    cleaned = stage(clean.min_history(_passed(base, rules, legs.columns), rules.min_rows), "audit-clean")
    normal = without_outliers(cleaned, register, rules)
    kept = stage(clean.min_history(normal, rules.min_rows), "audit-kept")
    tail = [("history", cleaned), ("outliers", normal), ("history_again", kept), *run_steps(kept, rules)]
    return audit.step_counts([("loaded", legs), ("known_ships", known), ("dedup", base)], row_rules(rules), tail)


def _passed(rated: DataFrame, rules: CleaningRules, cols: list[str]) -> DataFrame:
    return stage(rated.where(all_of([rule for _, rule in row_rules(rules)])).select(*cols), "audit-rows")


def register_to_classes(register: DataFrame, ship_types: list[str], k: int = 5) -> DataFrame:
    chosen = clean.register_clean(register).where(F.col("ship_type").isin(*ship_types))
    return classes.ship_classes(chosen, k=k)


@dataclass(frozen=True)
class Experiment:
    """One question asked of the records: which rows, which target, which inputs, which split."""

    name: str
    target: str
    features: tuple[str, ...] = tuple(FEATURES)
    label: int | None = None
    ships: tuple[int, ...] = ()
    test_share: float | None = None
    scale: tuple[str, ...] = tuple(SCALED_FEATURES)
    order: tuple[str, ...] = ("utc", "client")


# The subsets, targets and splits of the experiment matrix, keyed by what they ask.
EXPERIMENTS: dict[str, Experiment] = {
    e.name: e
    for e in [
        *[Experiment(f"tw_speed_class_{c}", "normalized_tw_speed", label=c) for c in range(5)],
        Experiment("tw_speed_all", "normalized_tw_speed"),
        *[Experiment(f"foc_class_{c}", "foc_me", label=c) for c in range(5)],
        *[Experiment(f"og_speed_class_{c}", "og_speed", label=c) for c in range(5)],
        Experiment("foc_time_cut_25", "foc_me", test_share=0.25),
        Experiment("foc_time_cut_20", "foc_me", test_share=0.20),
        Experiment("foc_time_cut_30", "foc_me", test_share=0.30),
    ]
}


def run_experiment(
    features: DataFrame, class_table: DataFrame, experiment: Experiment, bucket_hours: int = 24
) -> DataFrame:
    """Rows of the experiment with split ``type`` and prediction ``pred`` of a per-ship ridge model."""
    chosen = class_table if experiment.label is None else class_table.where(F.col("label") == experiment.label)
    rows = features.join(chosen.select("ship_id", "label"), "ship_id")
    if experiment.ships:
        rows = rows.where(F.col("ship_id").isin(*experiment.ships))
    order = list(experiment.order)
    rows = stage(rows, "experiment")
    if experiment.test_share is None:
        typed = splits.split_last_fold(rows, order, bucket_hours=bucket_hours)
    else:
        typed = splits.split_time_cut(rows, order, experiment.test_share, bucket_hours=bucket_hours)
    typed = stage(typed, "experiment-split")
    ready = scaling.standardize_splits(typed, [c for c in experiment.scale if c in experiment.features])
    ready = stage(ready, "experiment-scaled")
    # the test rows stay out of the fit; train and validation rows form the folds
    fitted_on = ridge.with_folds(ready.where("type <> 'test'"), order, test_share=0.0, bucket_hours=bucket_hours)
    models = ridge.fit_ridge(fitted_on, list(experiment.features), experiment.target)
    return ridge.predict(ready, models, list(experiment.features))


def error_report(results: DataFrame, target: str, pred: str = "pred") -> dict[str, DataFrame]:
    """Errors per split, per run and per class of one experiment."""
    by_run = evaluate.metrics_by_run(results, target, pred)
    return {
        "by_split": evaluate.metrics(results, ["type"], target, pred),
        "by_run": by_run,
        "by_class": evaluate.metrics(results.where("type = 'test'"), ["label"], target, pred),
        "coverage": evaluate.split_coverage(results),
    }
