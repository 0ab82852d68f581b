"""The flagship question: which continuous runs exist per ship, how long, how many isolated points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean, runs


def runs_of_ships(legs: DataFrame, gap: float = runs.GAP_HOURS, min_rows: int = 3, bucket_hours: int = 24) -> DataFrame:
    """Run table of the deduplicated telemetry, runs of at least ``min_rows`` rows."""
    once = clean.keep_first(legs, ["ship_id", "client", "utc"])
    found = runs.continuous_runs(once, gap=gap, bucket_hours=bucket_hours)
    return runs.run_table(runs.min_run_length(found, min_rows))
