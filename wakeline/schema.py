"""Column names, groups and declared types of the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# Declared columns of one telemetry record.
LEG_FLOAT = [
    "course", "crnt_u", "crnt_v", "draft_aft", "draft_fore", "foc_me", "foc_total", "lat", "lon", "og_speed",
    "pri_dir", "pri_ht", "pri_per", "sea_dir", "sea_ht", "sea_per", "sec_dir", "sec_ht", "sec_per", "sig_ht",
    "swl_dir", "swl_ht", "swl_per", "wind_u", "wind_v",
]
LEG_INT = ["deadweight", "power", "sst", "tw_speed"]
LEG_TEXT = ["client", "load", "loading_condition", "point_type", "rpm", "utc"]

LEG_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in sorted(
            [(c, T.FloatType()) for c in LEG_FLOAT]
            + [(c, T.IntegerType()) for c in LEG_INT]
            + [(c, T.StringType()) for c in LEG_TEXT]
        )
    ]
)
REGISTER_NUMERIC = [
    "length", "breadth", "depth", "draft", "dwt", "gt", "power_at_mcr", "speed_at_mcr", "rpm_at_mcr",
]
# read where present, not needed for a complete register row
REGISTER_OPTIONAL = ["date_built_year", "disp", "teu"]
SIZE_COLUMNS = ["length", "breadth", "depth", "draft", "dwt", "gt", "power_at_mcr"]

# Column groups of a telemetry row.
DRAFT = ["draft_aft", "draft_fore"]
PERFORMANCE = ["foc_me", "rpm"]
SPEED = ["og_speed", "course"]
CURRENT = ["crnt_u", "crnt_v"]
SEA = ["sea_dir", "sea_ht", "sea_per", "sig_ht"]
SWELL = ["swl_dir", "swl_ht", "swl_per"]
WIND = ["wind_u", "wind_v"]
WAVE = ["pri_ht", "pri_dir", "pri_per", "sec_ht", "sec_dir", "sec_per"]
POSITION = ["lat", "lon"]
KEY = ["ship_id", "utc", "client"]
WEATHER = WIND + SEA + SWELL + CURRENT
MEASURED = DRAFT + PERFORMANCE + SPEED + CURRENT + SEA + SWELL + WIND
RECORD = ["ship_id", "client", *sorted(MEASURED), "utc", "record_length", "record_index"]

# Feature sets of the models.
FEATURES = [
    "draft_aft", "draft_fore", "sig_ht", "crnt_L", "crnt_T", "wind_L", "wind_T", "sea_ht_L", "sea_ht_T",
    "sea_per_L", "sea_per_T", "swl_ht_L", "swl_ht_T", "swl_per_L", "swl_per_T", "normalized_rpm",
    "draft_sum_norm", "draft_diff_norm",
]
TARGETS = ["tw_speed", "normalized_tw_speed", "normalized_foc_me", "foc_me", "og_speed"]
IDS = ["ship_id", "client", "record_length", "record_index", "utc", "rpm"]
SHIP_FEATURES = ["length", "breadth", "depth", "draft", "dwt", "gt", "power_at_mcr", "rpm_at_mcr", "speed_at_mcr"]
# Ratios and targets stay unscaled in the second scaling scheme.
SCALED_FEATURES = FEATURES[:15]

LEGACY_WEATHER = [
    "crnt_lg", "wind_lg", "pri_lg", "sec_lg", "pri_tr", "sec_tr", "sea_lg", "sea_tr", "swl_lg", "swl_tr",
]
LEGACY_DRAFT = ["draft_aft", "draft_fore", "trim", "draft_mean"]
LEGACY_SHIP = [
    "dwt", "draft", "breadth", "length", "depth", "gt", "rpm_at_mcr", "speed_at_mcr", "power_at_mcr",
]
_BASE = LEGACY_WEATHER + LEGACY_DRAFT
FEATURE_SETS: dict[str, list[str]] = {
    "feats_1": _BASE + ["rpm", "og_speed"],
    "feats_2": _BASE + ["rpm", "og_speed"] + LEGACY_SHIP,
    "feats_3": _BASE + LEGACY_SHIP + ["speed_norm", "rpm_norm"],
    "feats_4": _BASE + ["rpm", "og_speed"] + LEGACY_SHIP + ["speed_norm", "rpm_norm"],
    "all_feats": _BASE + ["rpm", "og_speed"] + LEGACY_SHIP + ["date_built_year", "speed_norm", "rpm_norm"],
    "features": FEATURES,
    "all_features": FEATURES + SHIP_FEATURES,
}


def check_contract(df: DataFrame, known: list[str] = MEASURED, rest: list[str] = KEY) -> DataFrame:
    """Fail unless the columns outside the known groups are exactly ``rest``."""
    left = set(df.columns) - set(known)
    if left != set(rest):
        raise ValueError(f"unexpected columns {sorted(left - set(rest))}, absent {sorted(set(rest) - left)}")
    return df
