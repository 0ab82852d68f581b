"""Course-relative weather: angles and vector components.

Angles are in radians unless a name says degrees. Courses are compass courses (clockwise
from north), so the longitudinal part of a (u east, v north) vector is u*sin + v*cos.
The ``_math`` variant is the older counter-clockwise convention.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: metres per second to knots.
KNOTS_PER_MS = 3600 / 1852


def deg2rad(deg: str | Column) -> Column:
    return _c(deg) / F.lit(360.0) * F.lit(2 * math.pi)


def fold_degrees(deg: str | Column) -> Column:
    """Angles above 180 become 360 - a."""
    return F.when(_c(deg) > 180, F.lit(360.0) - _c(deg)).otherwise(_c(deg))


def lg_from_uv_math(u, v, course) -> Column:
    return _c(u) * F.cos(_c(course)) + _c(v) * F.sin(_c(course))


def lg_from_uv(u, v, course) -> Column:
    return _c(u) * F.sin(_c(course)) + _c(v) * F.cos(_c(course))


def tr_from_uv(u, v, course) -> Column:
    return _c(u) * F.cos(_c(course)) - _c(v) * F.sin(_c(course))


def lg_from_magnitude(m, m_dir, course) -> Column:
    return _c(m) * F.cos(_c(m_dir) - _c(course))


def tr_from_magnitude(m, m_dir, course, signed: bool = True) -> Column:
    """Transverse part; ``signed=False`` gives the older absolute form."""
    part = _c(m) * F.sin(_c(m_dir) - _c(course))
    return part if signed else F.abs(part)


def to_knots(ms: str | Column) -> Column:
    return F.lit(KNOTS_PER_MS) * _c(ms)


def vector_speed(u, v) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def vector_dir(u, v) -> Column:
    """Direction in [0, 2*pi)."""
    angle = F.atan2(_c(v), _c(u))
    return F.when(angle < 0, F.lit(2 * math.pi) + angle).otherwise(angle)


def relative_effect(speed, direction, course) -> Column:
    return _c(speed) * F.cos(_c(direction) - _c(course))


def relative_dir(direction, course) -> Column:
    return F.abs(_c(direction) - _c(course))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
