"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, clean, ridge, runs, voyages
from ..operators.sized import attach
from ..session import stage
from .filters import ROW, ROWS, WX, any_sql
from .registry import query, r, rc, rounded

# the rows-per-ship rule, scaled to the given tables
MIN_ROWS = 600

NUMBERED = """v AS (SELECT *, row_number() OVER (ORDER BY ship_id, dep_utc, arr_utc) AS rout_id
                    FROM (SELECT DISTINCT ship_id, dep_utc, arr_utc FROM f4_voyage))"""


@query(
    "join_register_left",
    f"""SELECT {ROWS}, speed_at_mcr, rpm_at_mcr, power_at_mcr FROM f2_leg
        LEFT JOIN (SELECT ship_id, speed_at_mcr, rpm_at_mcr, power_at_mcr FROM f3_register) USING (ship_id)""",
)
def _(t):
    ratings = ["speed_at_mcr", "rpm_at_mcr", "power_at_mcr"]
    return clean.join_ratings(t.f2_leg, t.f3_register, ratings).select(*ROW, *ratings)


@query(
    "join_class_inner",
    f"""WITH c AS (SELECT ship_id, label FROM f3_register WHERE power_at_mcr > 0 AND depth > 0),
          n AS (SELECT label, count(*) AS n_rows FROM f2_leg JOIN c USING (ship_id) GROUP BY label)
        SELECT label, n_rows, {r('n_rows / (SELECT count(*) FROM f2_leg)')} AS retained FROM n""",
)
def _(t):
    classed = clean.register_clean(t.f3_register).select("ship_id", "label")
    legs = t.f2_leg
    per_label = audit.count_by(legs.join(classed, "ship_id"), ["label"])
    total = legs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_label.withColumn("retained", rc(F.col("n_rows") / total))


@query(
    "semi_known_ships",
    f"""SELECT {ROWS} FROM f2_leg WHERE ship_id IN (SELECT ship_id FROM f3_register WHERE ship_type = 'BULK CARRIER')""",
)
def _(t):
    bulk = t.f3_register.where("ship_type = 'BULK CARRIER'").select("ship_id")
    return t.f2_leg.join(bulk, "ship_id", "left_semi").select(*ROW)


@query(
    "anti_dropped",
    f"""SELECT {ROWS} FROM f2_leg WHERE ship_id NOT IN
        (SELECT ship_id FROM f2_leg GROUP BY ship_id HAVING count(*) >= {MIN_ROWS})""",
)
def _(t):
    legs = t.f2_leg
    return attach(legs, clean.long_history(legs, MIN_ROWS), ["ship_id"], "left_anti").select(*ROW)


@query(
    "voyage_interval_join",
    f"""WITH {NUMBERED}
        SELECT {ROWS}, coalesce((SELECT max(rout_id) FROM v WHERE v.ship_id = l.ship_id
            AND l.utc BETWEEN v.dep_utc AND v.arr_utc), 0) AS rout_id FROM f2_leg l""",
)
def _(t):
    numbered = stage(voyages.number_voyages(t.f4_voyage), "voyages")
    return voyages.label_voyages(t.f2_leg.select(*ROW), numbered)


@query(
    "attach_derived",
    """WITH g AS (SELECT *, (epoch_us(utc) - epoch_us(lag(utc) OVER w)) / 3.6e9 AS s1,
          (epoch_us(lead(utc) OVER w) - epoch_us(utc)) / 3.6e9 AS s2 FROM f1_leg_events
          WINDOW w AS (PARTITION BY ship_id, client ORDER BY utc))
       SELECT event_id, foc_me, coalesce(s1, 100) > 6 AND coalesce(s2, 100) > 6 AS isolated,
          coalesce(s1, 100) > 6 AND coalesce(s2, 100) <= 6 AS is_start,
          coalesce(s1, 100) <= 6 AND coalesce(s2, 100) > 6 AS is_end FROM g""",
)
def _(t):
    flagged = runs.point_class(t.f1_leg_events)
    return flagged.select(
        "event_id",
        "foc_me",
        (F.col("point_class") == "isolated").alias("isolated"),
        (F.col("point_class") == "start").alias("is_start"),
        (F.col("point_class") == "end").alias("is_end"),
    )


@query(
    "retention_outer",
    f"""WITH b AS (SELECT ship_id, count(*) AS rows_before FROM f2_leg GROUP BY ship_id),
          a AS (SELECT ship_id, count(*) AS rows_after FROM f2_leg WHERE NOT ({any_sql('>= 9000')}) GROUP BY ship_id)
        SELECT ship_id, coalesce(rows_before, 0) AS rows_before, coalesce(rows_after, 0) AS rows_after,
          {r('coalesce(rows_after, 0) / rows_before')} AS retained FROM b FULL JOIN a USING (ship_id)""",
)
def _(t):
    legs = t.f2_leg
    return rounded(audit.retention(legs, clean.missing_ge(legs, WX)), ["retained"])


@query(
    "attach_group_size",
    """SELECT ship_id, ship_type, n_samples FROM f3_register
       LEFT JOIN (SELECT ship_id, count(*) AS n_samples FROM f2_leg GROUP BY ship_id) USING (ship_id)""",
)
def _(t):
    sizes = audit.count_by(t.f2_leg, ["ship_id"], "n_samples")
    return t.f3_register.select("ship_id", "ship_type").join(sizes, "ship_id", "left")


# Steps per axis, 20 million points.
GRID_AXES = {"rpm": 10, "draft_aft": 10, "og_speed": 10, "sea_ht": 10, "swl_ht": 10, "wind_v": 20, "crnt_v": 10}


def _grid_sql() -> str:
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in GRID_AXES)
    axes = " ".join(f"CROSS JOIN (SELECT unnest(range({n})) AS i_{c})" for c, n in GRID_AXES.items())
    value = {c: f"lo_{c} + (hi_{c} - lo_{c}) * i_{c} / CAST({n - 1} AS DOUBLE)" for c, n in GRID_AXES.items()}
    means = ", ".join(f"{r(f'avg({v})')} AS {c}" for c, v in value.items())
    return f"""WITH e AS (SELECT {ends} FROM f2_leg)
        SELECT CAST(i_rpm AS INTEGER) AS i_rpm, CAST(i_wind_v AS INTEGER) AS i_wind_v, count(*) AS n_points, {means}
        FROM e {axes} GROUP BY i_rpm, i_wind_v"""


@query("scenario_grid", _grid_sql())
def _(t):
    grid = ridge.scenario_grid(t.f2_leg, GRID_AXES)
    means = [rc(F.avg(c)).alias(c) for c in GRID_AXES]
    return grid.groupBy("i_rpm", "i_wind_v").agg(F.count(F.lit(1)).alias("n_points"), *means)


@query(
    "result_context",
    f"""SELECT ship_id, label, type, count(*) AS n_rows, {r('avg(speed_at_mcr)')} AS speed_at_mcr, {r('avg(rpm_at_mcr)')} AS rpm_at_mcr
        FROM f5_prediction LEFT JOIN (SELECT ship_id, label, speed_at_mcr, rpm_at_mcr FROM f3_register) USING (ship_id)
        GROUP BY ship_id, label, type""",
)
def _(t):
    joined = clean.join_ratings(t.f5_prediction, t.f3_register, ["label", "speed_at_mcr", "rpm_at_mcr"])
    return joined.groupBy("ship_id", "label", "type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        rc(F.avg("speed_at_mcr")).alias("speed_at_mcr"),
        rc(F.avg("rpm_at_mcr")).alias("rpm_at_mcr"),
    )
