"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, evaluate
from ..schema import KEY, MEASURED, check_contract
from ..sources.files import scan_register
from .registry import query, r, rc

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "ship_id", "utc"]
ROWS = ", ".join(ROW)
# weather columns of the fixture
WX = ["wind_u", "wind_v", "sea_dir", "sea_ht", "sea_per", "sig_ht", "swl_dir", "swl_ht", "swl_per", "crnt_u", "crnt_v"]


def any_sql(test: str, cols=WX) -> str:
    return " OR ".join(f"coalesce({c} {test}, FALSE)" for c in cols)


RATED = "ship_id, draft, speed_at_mcr, rpm_at_mcr, power_at_mcr"
RATED_SQL = (
    "og_speed > 0 AND og_speed < speed_at_mcr AND rpm > 0 AND rpm < rpm_at_mcr "
    "AND draft_aft < 1.5 * draft AND draft_fore < 1.5 * draft AND foc_me > 0"
)


def rated(t):
    return clean.join_ratings(t.f2_leg, t.f3_register, ["draft", "speed_at_mcr", "rpm_at_mcr", "power_at_mcr"])


@query("drop_columns", "SELECT ship_id, client, utc, foc_me FROM f1_leg_events")
def _(t):
    return t.f1_leg_events.drop("event_id")


@query(
    "safe_numeric_cast",
    """SELECT l_orderkey, l_linenumber, ship_id, TRY_CAST(rpm AS DOUBLE) AS rpm FROM f6_leg_text
       WHERE rpm IS NULL OR TRY_CAST(rpm AS DOUBLE) IS NOT NULL""",
)
def _(t):
    good, _rejected = clean.safe_numeric_cast(t.f6_leg_text, ["rpm"])
    return good.withColumn("rpm", F.col("rpm").cast("double"))


@query(
    "safe_numeric_cast_rejects",
    """SELECT l_orderkey, l_linenumber, ship_id, rpm FROM f6_leg_text
       WHERE rpm IS NOT NULL AND TRY_CAST(rpm AS DOUBLE) IS NULL""",
)
def _(t):
    return clean.safe_numeric_cast(t.f6_leg_text, ["rpm"])[1]


@query("schema_contract", "SELECT ship_id, client, count(*) AS n_rows FROM f2_leg GROUP BY ship_id, client")
def _(t):
    checked = check_contract(t.f2_leg.select(*MEASURED, *KEY))
    return checked.groupBy("ship_id", "client").agg(F.count(F.lit(1)).alias("n_rows"))


@query("rename", "SELECT ship_id, ship_type, power_at_mcr, speed_at_mcr FROM f3_register")
def _(t):
    raw = t.f3_register.withColumnsRenamed({"ship_id": "wni_ship_num", "power_at_mcr": "bhp"})
    return scan_register(raw).select("ship_id", "ship_type", "power_at_mcr", "speed_at_mcr")


@query(
    "cast",
    """SELECT ship_id, CAST(CAST(length AS VARCHAR) AS DOUBLE) AS length, CAST(depth AS DOUBLE) AS depth,
         CAST(dwt AS INTEGER) AS dwt FROM f3_register""",
)
def _(t):
    text = t.f3_register.select("ship_id", F.col("length").cast("string").alias("length"), "depth", "dwt")
    return scan_register(text).withColumn("dwt", F.col("dwt").cast("int"))


@query("missing_eq", f"SELECT {ROWS}, wind_u, crnt_u FROM f2_leg WHERE NOT ({any_sql('= 9999')})")
def _(t):
    return clean.missing_eq(t.f2_leg, WX).select(*ROW, "wind_u", "crnt_u")


@query("missing_ge", f"SELECT {ROWS}, wind_u, crnt_u FROM f2_leg WHERE NOT ({any_sql('>= 9000')})")
def _(t):
    return clean.missing_ge(t.f2_leg, WX).select(*ROW, "wind_u", "crnt_u")


DIRS = ["course", "pri_dir", "sea_dir", "sec_dir", "swl_dir"]


@query(
    "dir_nonneg_all",
    f"SELECT {ROWS}, {', '.join(DIRS)} FROM f2_leg WHERE " + " AND ".join(f"{c} >= 0" for c in DIRS),
)
def _(t):
    return clean.dir_nonneg_all(t.f2_leg, DIRS).select(*ROW, *DIRS)


@query("dir_positive", f"SELECT {ROWS}, sea_dir, swl_dir FROM f2_leg WHERE sea_dir > 0 AND swl_dir > 0")
def _(t):
    return clean.dir_positive(t.f2_leg).select(*ROW, "sea_dir", "swl_dir")


@query(
    "rated_range",
    f"""SELECT {ROWS}, og_speed, rpm, draft_aft FROM f2_leg LEFT JOIN (SELECT {RATED} FROM f3_register) USING (ship_id)
        WHERE {RATED_SQL}""",
)
def _(t):
    return clean.rated_range(rated(t)).select(*ROW, "og_speed", "rpm", "draft_aft")


@query(
    "min_load",
    f"""SELECT {ROWS}, og_speed, rpm FROM f2_leg LEFT JOIN (SELECT {RATED} FROM f3_register) USING (ship_id)
        WHERE og_speed >= 0.15E0 * speed_at_mcr AND rpm >= 0.15E0 * rpm_at_mcr AND foc_me > 0""",
)
def _(t):
    return clean.min_load(rated(t)).select(*ROW, "og_speed", "rpm")


@query(
    "violation_counts",
    f"""SELECT count(*) FILTER (WHERE og_speed <= 0 OR og_speed > speed_at_mcr) AS bad_og_speed,
          count(*) FILTER (WHERE rpm <= 0 OR rpm > rpm_at_mcr) AS bad_rpm,
          count(*) FILTER (WHERE draft_aft < 0 OR draft_aft >= 1.5 * draft) AS bad_draft_aft,
          count(*) FILTER (WHERE draft_fore < 0 OR draft_fore >= 1.5 * draft) AS bad_draft_fore
        FROM f2_leg LEFT JOIN (SELECT {RATED} FROM f3_register) USING (ship_id)""",
)
def _(t):
    return clean.violation_counts(rated(t))


# An example list, as the reports name single ships and runs.
LISTED_SHIPS = [3, 5, 7]
BAD_RUNS = [1, 2, 3, 32]


@query(
    "isin_list",
    """SELECT ship_id, record_index, tw_speed, pred_tw_speed FROM f5_prediction
       WHERE ship_id IN (3, 5, 7) AND record_index NOT IN (1, 2, 3, 32)""",
)
def _(t):
    df = t.f5_prediction
    return df.where(F.col("ship_id").isin(*LISTED_SHIPS) & ~F.col("record_index").isin(*BAD_RUNS)).select(
        "ship_id", "record_index", "tw_speed", "pred_tw_speed"
    )


@query(
    "label_filter",
    f"""SELECT {ROWS}, label FROM f2_leg JOIN (SELECT ship_id, label FROM f3_register) USING (ship_id) WHERE label = 1""",
)
def _(t):
    chosen = t.f3_register.where("label = 1").select("ship_id", "label")
    return t.f2_leg.join(chosen, "ship_id").select(*ROW, "label")


@query(
    "time_slice",
    f"""SELECT {ROWS}, foc_me FROM f2_leg
        WHERE ship_id = 5 AND utc BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'""",
)
def _(t):
    inside = F.col("utc").between(
        F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")
    )
    return t.f2_leg.where((F.col("ship_id") == 5) & inside).select(*ROW, "foc_me")


@query(
    "register_clean",
    """SELECT * FROM f3_register WHERE power_at_mcr IS NOT NULL AND depth > 0 AND power_at_mcr > 0""",
)
def _(t):
    return clean.register_clean(t.f3_register)


@query(
    "register_range",
    f"""SELECT {ROWS}, og_speed, rpm_at_mcr, speed_at_mcr FROM f2_leg
        JOIN (SELECT ship_id, rpm_at_mcr, speed_at_mcr FROM f3_register
              WHERE rpm_at_mcr < 140 AND speed_at_mcr BETWEEN 13 AND 15) USING (ship_id)
        WHERE og_speed BETWEEN 8.4E0 AND 20.36E0""",
)
def _(t):
    ranged = t.f3_register.where("rpm_at_mcr < 140 AND speed_at_mcr BETWEEN 13 AND 15")
    trimmed = t.f2_leg.where(F.col("og_speed").between(8.4, 20.36))
    return trimmed.join(ranged.select("ship_id", "rpm_at_mcr", "speed_at_mcr"), "ship_id").select(
        *ROW, "og_speed", "rpm_at_mcr", "speed_at_mcr"
    )


@query(
    "fill_missing",
    """SELECT ship_id, coalesce(power_at_mcr, 0) AS power_at_mcr,
         coalesce(CAST(CAST(power_at_mcr AS INTEGER) AS VARCHAR), 'unknown') AS power_text FROM f3_register""",
)
def _(t):
    reg = t.f3_register.select("ship_id", "power_at_mcr").withColumn(
        "power_text", F.col("power_at_mcr").cast("int").cast("string")
    )
    return reg.na.fill({"power_at_mcr": 0.0, "power_text": "unknown"})


@query(
    "error_bands",
    f"""WITH e AS (SELECT type, record_index, CASE WHEN x > -0.25E0 THEN 'above' WHEN x <= -0.25E0 THEN 'below' END AS segment,
            x, y - p AS d FROM (SELECT *, tw_speed AS y, pred_tw_speed AS p,
            (tw_speed - pred_tw_speed) / nullif(tw_speed, 0) AS x FROM f5_prediction)),
          m AS (SELECT type, record_index, avg(abs(x)) * 100 AS mape, avg(abs(d)) AS mae,
            count(*) FILTER (WHERE segment = 'below') AS n_below FROM e GROUP BY type, record_index)
        SELECT type, record_index, n_below, {r('mape')} AS mape, {r('mae')} AS mae,
          CASE WHEN {r('mape')} > 0.5E0 AND {r('mape')} < 2 THEN 'good' WHEN {r('mape')} > 7.5E0 THEN 'bad'
               WHEN {r('mae')} > 1 THEN 'high_mae' WHEN {r('mae')} > 0.2E0 AND {r('mae')} < 0.5E0 THEN 'moderate_mae'
               ELSE 'other' END AS band FROM m""",
)
def _(t):
    res = evaluate.residuals(t.f5_prediction, "tw_speed", "pred_tw_speed")
    by_run = res.groupBy("type", "record_index").agg(
        F.count_if(evaluate.error_segment("error") == "below").alias("n_below"),
        *evaluate.error_aggs("tw_speed", "pred_tw_speed", ["mape", "mae"]),
    )
    tidy = by_run.withColumns({"mape": rc("mape"), "mae": rc("mae")})
    return tidy.withColumn("band", evaluate.quality_band())


@query(
    "sentinel_ship_audit",
    """SELECT DISTINCT ship_id FROM f2_leg WHERE crnt_u > 9000 OR crnt_v > 9000 OR wind_u > 9000""",
)
def _(t):
    return t.f2_leg.where("crnt_u > 9000 OR crnt_v > 9000 OR wind_u > 9000").select("ship_id").distinct()
