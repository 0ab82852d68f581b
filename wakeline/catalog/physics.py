"""Scalar domain functions and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import performance as perf, weather as wx
from ..plans.features import feature_table, legacy_features
from ..schema import FEATURES, TARGETS
from .filters import ROW, ROWS, rated
from .registry import query, r, rc, rounded

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
IDS = ", ".join(ID)
PI2 = "2 * pi()"
COURSE = f"(course / 360.0E0 * ({PI2}))"
SEA = f"(sea_dir / 360.0E0 * ({PI2}))"
PRI = f"(pri_dir / 360.0E0 * ({PI2}))"
SEC = f"(sec_dir / 360.0E0 * ({PI2}))"
SWL = f"(swl_dir / 360.0E0 * ({PI2}))"
KN = "(3600.0E0 / 1852.0E0)"
KW = "(power_at_mcr * 0.745699872E0)"
RATED_F2 = """f2_leg LEFT JOIN (SELECT ship_id, draft, speed_at_mcr, rpm_at_mcr, power_at_mcr FROM f3_register) USING (ship_id)"""


def leg_query(key: str, columns: dict[str, tuple[str, object]], source: str = "f2_leg", joined: bool = False):
    """Register a projection given as name -> (SQL, column)."""
    select = ", ".join(f"{r(sql)} AS {name}" for name, (sql, _col) in columns.items())

    @query(key, f"SELECT {IDS}, {select} FROM {RATED_F2 if joined else source}")
    def _(t):
        rows = rated(t) if joined else getattr(t, source)
        return rows.select(*ID, *[rc(col()).alias(name) for name, (_sql, col) in columns.items()])


def course():
    return wx.deg2rad("course")


def sea():
    return wx.deg2rad("sea_dir")


def swl():
    return wx.deg2rad("swl_dir")


def lg(u: str, v: str) -> str:
    return f"({u} * sin({COURSE}) + {v} * cos({COURSE}))"


def tr(u: str, v: str) -> str:
    return f"({u} * cos({COURSE}) - {v} * sin({COURSE}))"


def lgm(m: str, d: str) -> str:
    return f"({m} * cos({d} - {COURSE}))"


def trm(m: str, d: str) -> str:
    return f"({m} * sin({d} - {COURSE}))"


leg_query("deg2rad", {"course_rad": (COURSE, course), "sea_rad": (SEA, sea), "swl_rad": (SWL, swl)})
leg_query(
    "fold_degrees",
    {
        "course_folded": ("CASE WHEN course > 180 THEN 360 - course ELSE course END", lambda: wx.fold_degrees("course")),
        "sea_folded": ("CASE WHEN sea_dir > 180 THEN 360 - sea_dir ELSE sea_dir END", lambda: wx.fold_degrees("sea_dir")),
    },
)
leg_query(
    "lg_from_uv_math",
    {"crnt_lg": (f"crnt_u * cos({COURSE}) + crnt_v * sin({COURSE})", lambda: wx.lg_from_uv_math("crnt_u", "crnt_v", course()))},
)
leg_query("lg_from_uv", {"wind_l": (lg("wind_u", "wind_v"), lambda: wx.lg_from_uv("wind_u", "wind_v", course()))})
leg_query("tr_from_uv", {"wind_t": (tr("wind_u", "wind_v"), lambda: wx.tr_from_uv("wind_u", "wind_v", course()))})
leg_query(
    "lg_from_magnitude",
    {
        "sea_ht_l": (lgm("sea_ht", SEA), lambda: wx.lg_from_magnitude("sea_ht", sea(), course())),
        "swl_per_l": (lgm("swl_per", SWL), lambda: wx.lg_from_magnitude("swl_per", swl(), course())),
    },
)
leg_query(
    "tr_from_magnitude",
    {
        "sea_ht_t": (trm("sea_ht", SEA), lambda: wx.tr_from_magnitude("sea_ht", sea(), course())),
        "sea_ht_abs": (f"abs({trm('sea_ht', SEA)})", lambda: wx.tr_from_magnitude("sea_ht", sea(), course(), signed=False)),
    },
)
leg_query(
    "to_knots",
    {
        "crnt_u_kn": (f"{KN} * crnt_u", lambda: wx.to_knots("crnt_u")),
        "wind_v_kn": (f"{KN} * wind_v", lambda: wx.to_knots("wind_v")),
    },
)
POLAR = {
    "crnt_speed": ("sqrt(crnt_u * crnt_u + crnt_v * crnt_v)", lambda: wx.vector_speed("crnt_u", "crnt_v")),
    "crnt_dir": (
        f"CASE WHEN atan2(crnt_v, crnt_u) < 0 THEN {PI2} + atan2(crnt_v, crnt_u) ELSE atan2(crnt_v, crnt_u) END",
        lambda: wx.vector_dir("crnt_u", "crnt_v"),
    ),
}
leg_query("uv_to_polar", POLAR)
_speed, _dir = POLAR["crnt_speed"], POLAR["crnt_dir"]
_effect = (f"({_speed[0]} * cos(({_dir[0]}) - {COURSE}))", lambda: wx.relative_effect(_speed[1](), _dir[1](), course()))
leg_query(
    "relative_effect",
    {
        "crnt_effect": _effect,
        "crnt_rdir": (f"abs(({_dir[0]}) - {COURSE})", lambda: wx.relative_dir(_dir[1](), course())),
        "rpm_squared": ("rpm * rpm", lambda: F.col("rpm") * F.col("rpm")),
        "og_speed_squared": ("og_speed * og_speed", lambda: F.col("og_speed") * F.col("og_speed")),
    },
)
leg_query(
    "trim_draft_abs",
    {
        "trim_m": ("draft_fore - draft_aft", lambda: perf.trim_abs()),
        "draft_mean": ("(draft_fore + draft_aft) / 2", lambda: perf.mean_draft()),
    },
)
leg_query(
    "trim_draft_norm",
    {
        "draft_diff_norm": ("(draft_fore - draft_aft) / nullif(draft, 0)", lambda: perf.draft_diff_norm()),
        "draft_sum_norm": ("(draft_fore + draft_aft) / nullif(draft, 0)", lambda: perf.draft_sum_norm()),
    },
    joined=True,
)
leg_query("hp_to_kw", {"power_kw": (KW, lambda: perf.hp_to_kw("power_at_mcr"))}, joined=True)
CRNT_L = f"({KN} * {lg('crnt_u', 'crnt_v')})"


def crnt_l():
    return wx.to_knots(wx.lg_from_uv("crnt_u", "crnt_v", course()))


TW = f"(og_speed - {CRNT_L})"


def tw():
    return perf.true_water_speed("og_speed", crnt_l())


leg_query("true_water_speed", {"tw_speed": (TW, tw)})
leg_query(
    "norm_rpm",
    {
        "normalized_rpm": ("rpm / nullif(rpm_at_mcr, 0)", lambda: perf.norm_rpm()),
        "normalized_rpm_cubed": (
            "(rpm / nullif(rpm_at_mcr, 0)) * (rpm / nullif(rpm_at_mcr, 0)) * (rpm / nullif(rpm_at_mcr, 0))",
            lambda: perf.cube(perf.norm_rpm()),
        ),
    },
    joined=True,
)
leg_query(
    "norm_speed",
    {
        "tw_over_og": (f"{TW} / nullif(og_speed, 0)", lambda: perf.norm_speed(tw(), "og_speed")),
        "tw_over_rated": (f"{TW} / nullif(speed_at_mcr, 0)", lambda: perf.norm_speed(tw())),
        "og_over_rated": ("og_speed / nullif(speed_at_mcr, 0)", lambda: perf.norm_speed("og_speed")),
    },
    joined=True,
)
leg_query(
    "norm_foc",
    {"normalized_foc_me": (f"foc_me / nullif({KW}, 0)", lambda: perf.norm_foc("foc_me", perf.hp_to_kw("power_at_mcr")))},
    joined=True,
)

FEATURE_SQL = {
    "draft_aft": "draft_aft", "draft_fore": "draft_fore", "sig_ht": "sig_ht",
    "crnt_L": CRNT_L, "crnt_T": f"{KN} * {tr('crnt_u', 'crnt_v')}",
    "wind_L": f"{KN} * {lg('wind_u', 'wind_v')}", "wind_T": f"{KN} * {tr('wind_u', 'wind_v')}",
    "sea_ht_L": lgm("sea_ht", SEA), "sea_ht_T": trm("sea_ht", SEA),
    "sea_per_L": lgm("sea_per", SEA), "sea_per_T": trm("sea_per", SEA),
    "swl_ht_L": lgm("swl_ht", SWL), "swl_ht_T": trm("swl_ht", SWL),
    "swl_per_L": lgm("swl_per", SWL), "swl_per_T": trm("swl_per", SWL),
    "normalized_rpm": "rpm / nullif(rpm_at_mcr, 0)",
    "draft_sum_norm": "(draft_fore + draft_aft) / nullif(draft, 0)",
    "draft_diff_norm": "(draft_fore - draft_aft) / nullif(draft, 0)",
    "tw_speed": TW, "normalized_tw_speed": f"{TW} / nullif(speed_at_mcr, 0)",
    "normalized_foc_me": f"foc_me / nullif({KW}, 0)", "foc_me": "foc_me", "og_speed": "og_speed",
}


@query(
    "feature_table",
    f"SELECT {ROWS}, client, {', '.join(f'{r(sql)} AS {n}' for n, sql in FEATURE_SQL.items())} FROM {RATED_F2}",
)
def _(t):
    table = feature_table(t.f2_leg, t.f3_register, keep=[*ROW, "client"])
    return rounded(table, FEATURES + TARGETS)


LEGACY_SQL = {
    "crnt_lg": f"crnt_u * cos({COURSE}) + crnt_v * sin({COURSE})",
    "wind_lg": f"wind_u * cos({COURSE}) + wind_v * sin({COURSE})",
    "pri_lg": lgm("pri_ht", PRI), "pri_tr": f"abs({trm('pri_ht', PRI)})",
    "sec_lg": lgm("sec_ht", SEC), "sec_tr": f"abs({trm('sec_ht', SEC)})",
    "sea_lg": lgm("sea_ht", SEA), "sea_tr": f"abs({trm('sea_ht', SEA)})",
    "swl_lg": lgm("swl_ht", SWL), "swl_tr": f"abs({trm('swl_ht', SWL)})",
    "trim_m": "draft_fore - draft_aft", "draft_mean": "(draft_fore + draft_aft) / 2",
    "speed_norm": "og_speed / nullif(speed_at_mcr, 0)", "rpm_norm": "rpm / nullif(rpm_at_mcr, 0)",
}


@query(
    "features_legacy",
    f"SELECT {ROWS}, {', '.join(f'{r(sql)} AS {n}' for n, sql in LEGACY_SQL.items())} FROM {RATED_F2}",
)
def _(t):
    table = legacy_features(rated(t)).withColumnRenamed("trim", "trim_m")
    return rounded(table.select(*ROW, *LEGACY_SQL), list(LEGACY_SQL))


@query(
    "month_of",
    "SELECT ship_id, CAST(month(utc) AS INTEGER) AS month_no, count(*) AS n_rows FROM f2_leg GROUP BY ship_id, month_no",
)
def _(t):
    return t.f2_leg.groupBy("ship_id", F.month("utc").alias("month_no")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "rebase_year",
    """SELECT o_orderkey, TRY_CAST(y AS INTEGER) - 2000 AS year_no FROM (SELECT o_orderkey,
         CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y FROM orders)""",
)
def _(t):
    text = F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.year("o_orderdate").cast("string"))
    return t.table("orders").select("o_orderkey", perf.rebase_year(text).alias("year_no"))


leg_query(
    "denormalise_pred",
    {
        # og_speed / 20 stands in for a predicted normalised speed, foc_me / 1000 for a predicted normalised fuel
        "pred_tw_speed": ("og_speed / 20.0E0 * speed_at_mcr", lambda: perf.denorm_speed(F.col("og_speed") / 20.0)),
        "pred_og_speed": (
            f"og_speed / 20.0E0 * speed_at_mcr + {CRNT_L}",
            lambda: perf.denorm_speed(F.col("og_speed") / 20.0) + crnt_l(),
        ),
        "pred_foc_me": (f"foc_me / 1000.0E0 * {KW}", lambda: perf.denorm_foc(F.col("foc_me") / 1000.0)),
    },
    joined=True,
)
