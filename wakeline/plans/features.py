"""Feature tables of the models, each one projection over rows joined with their ship's ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import performance as perf, weather as wx
from ..operators import scaling
from ..operators.sized import small
from ..schema import FEATURES, IDS, SCALED_FEATURES, SHIP_FEATURES, TARGETS

RATINGS = ["draft", "speed_at_mcr", "rpm_at_mcr", "power_at_mcr"]


def add_components(df: DataFrame) -> DataFrame:
    """The 12 course-relative weather components; angles in degrees on input."""
    course, sea, swl = wx.deg2rad("course"), wx.deg2rad("sea_dir"), wx.deg2rad("swl_dir")
    out = {}
    for name in ("crnt", "wind"):
        u, v = f"{name}_u", f"{name}_v"
        out[f"{name}_L"] = wx.to_knots(wx.lg_from_uv(u, v, course))
        out[f"{name}_T"] = wx.to_knots(wx.tr_from_uv(u, v, course))
    for name, direction in (("sea", sea), ("swl", swl)):
        for part in ("ht", "per"):
            m = f"{name}_{part}"
            out[f"{m}_L"] = wx.lg_from_magnitude(m, direction, course)
            out[f"{m}_T"] = wx.tr_from_magnitude(m, direction, course)
    return df.withColumns(out)


def add_ratios(df: DataFrame) -> DataFrame:
    """Normalised performance features and targets."""
    kw = perf.hp_to_kw("power_at_mcr")
    return df.withColumns(
        {
            "normalized_rpm": perf.norm_rpm(),
            "draft_diff_norm": perf.draft_diff_norm(),
            "draft_sum_norm": perf.draft_sum_norm(),
            "tw_speed": perf.true_water_speed(),
            "normalized_tw_speed": perf.norm_speed(perf.true_water_speed()),
            "normalized_foc_me": perf.norm_foc("foc_me", kw),
        }
    )


def feature_table(records: DataFrame, register: DataFrame, keep: list[str] = IDS) -> DataFrame:
    """Ids, 18 features and 5 targets per row."""
    rated = records.join(register.select("ship_id", *RATINGS), "ship_id", "left")
    return add_ratios(add_components(rated)).select(*dict.fromkeys([*keep, *FEATURES, *TARGETS]))


def pooled_table(features: DataFrame, classes: DataFrame, split: str = "type", by: str = "label") -> DataFrame:
    """The 27 inputs of the pooled models beside ids and targets: rows of classified ships only.

    Register columns are scaled over the ships of a class, drafts and weather over the class's training and validation
    rows; ratios and targets stay as they are. ``speed_at_mcr`` and ``rpm_at_mcr`` are then scaled values.
    """
    ships = scaling.standardize_by(classes.select("ship_id", by, *SHIP_FEATURES), SHIP_FEATURES, [by])
    held = features.join(small(ships), "ship_id")
    return scaling.standardize_by(held, SCALED_FEATURES, [by], held.where(F.col(split) != "test"))


def legacy_features(df: DataFrame, waves: tuple[str, ...] = ("pri", "sec", "sea", "swl")) -> DataFrame:
    """The older set: mathematical angle convention, absolute transverse parts, plain trim."""
    course = wx.deg2rad("course")
    out = {
        "crnt_lg": wx.lg_from_uv_math("crnt_u", "crnt_v", course),
        "wind_lg": wx.lg_from_uv_math("wind_u", "wind_v", course),
    }
    for name in waves:
        direction = wx.deg2rad(f"{name}_dir")
        out[f"{name}_lg"] = wx.lg_from_magnitude(f"{name}_ht", direction, course)
        out[f"{name}_tr"] = wx.tr_from_magnitude(f"{name}_ht", direction, course, signed=False)
    out["trim"] = perf.trim_abs()
    out["draft_mean"] = perf.mean_draft()
    out["speed_norm"] = perf.norm_speed("og_speed")
    out["rpm_norm"] = perf.norm_rpm()
    return df.withColumns(out)


def outlier_features(df: DataFrame, register: DataFrame) -> DataFrame:
    """The three normalised columns the joint outlier score looks at; NULL where ratings lack."""
    rated = df.join(register.select("ship_id", "speed_at_mcr", "rpm_at_mcr", "power_at_mcr"), "ship_id", "left")
    current = wx.to_knots(wx.lg_from_uv("crnt_u", "crnt_v", wx.deg2rad("course")))
    return rated.withColumns(
        {
            "norm_rpm3": perf.cube(perf.norm_rpm()),
            "norm_foc_me": perf.norm_foc("foc_me", perf.hp_to_kw("power_at_mcr")),
            "norm_tw_speed": perf.norm_speed(F.col("og_speed") - current),
        }
    ).drop("speed_at_mcr", "rpm_at_mcr", "power_at_mcr")
