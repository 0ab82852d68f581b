"""Ratios of measured performance to the ship's ratings. Zero ratings give NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: kilowatts per horsepower.
KW_PER_HP = 0.745699872


def hp_to_kw(power: str | Column) -> Column:
    return _c(power) * F.lit(KW_PER_HP)


def trim_abs(fore="draft_fore", aft="draft_aft") -> Column:
    return _c(fore) - _c(aft)


def mean_draft(fore="draft_fore", aft="draft_aft") -> Column:
    return (_c(fore) + _c(aft)) / F.lit(2.0)


def draft_diff_norm(fore="draft_fore", aft="draft_aft", draft="draft") -> Column:
    return F.try_divide(_c(fore) - _c(aft), _c(draft))


def draft_sum_norm(fore="draft_fore", aft="draft_aft", draft="draft") -> Column:
    return F.try_divide(_c(fore) + _c(aft), _c(draft))


def true_water_speed(og_speed="og_speed", crnt_l="crnt_L") -> Column:
    """Speed through water: speed over ground less the longitudinal current, both in knots."""
    return _c(og_speed) - _c(crnt_l)


def norm_rpm(rpm="rpm", rated="rpm_at_mcr") -> Column:
    return F.try_divide(_c(rpm), _c(rated))


def cube(x: str | Column) -> Column:
    return _c(x) * _c(x) * _c(x)


def norm_speed(speed="tw_speed", rated="speed_at_mcr") -> Column:
    return F.try_divide(_c(speed), _c(rated))


def norm_foc(foc="foc_me", power_kw: str | Column = "power_kw") -> Column:
    return F.try_divide(_c(foc), _c(power_kw))


def denorm_speed(pred="pred_normalized_tw_speed", rated="speed_at_mcr") -> Column:
    return _c(pred) * _c(rated)


def denorm_foc(pred="pred_normalized_foc_me", power_hp="power_at_mcr") -> Column:
    return _c(pred) * hp_to_kw(power_hp)


def rebase_year(year: str | Column, base: int = 2000) -> Column:
    """Years after ``base``; text that is not a year gives NULL."""
    return _c(year).cast("string").try_cast("int") - F.lit(base)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
