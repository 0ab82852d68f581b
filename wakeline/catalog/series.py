"""Window and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, runs, splits, voyages
from ..session import stage
from .filters import ROW, ROWS
from .joins import NUMBERED
from .registry import query, r, rc, rounded

# Rows of f2 in a total order: every column that can differ decides.
ORDER = ["utc", "client", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "foc_me", "og_speed", "rpm"]
ORDERS = ", ".join(ORDER)
ALL_KEYS = ["ship_id", *ORDER]
ALL_F2 = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, foc_me, og_speed, rpm"


def gaps_sql(view: str) -> str:
    return f"""g AS (SELECT *, coalesce((epoch_us(utc) - epoch_us(lag(utc) OVER w)) / 3.6e9, 100) AS s1,
        coalesce((epoch_us(lead(utc) OVER w) - epoch_us(utc)) / 3.6e9, 100) AS s2 FROM {view}
        WINDOW w AS (PARTITION BY ship_id, client ORDER BY utc))"""


def runs_sql(view: str) -> str:
    """CTE ``runs``: non-isolated rows with record_index and record_length."""
    return f"""{gaps_sql(view)},
      n AS (SELECT *, CAST(sum(CASE WHEN s1 > 6 THEN 1 ELSE 0 END) OVER (ORDER BY ship_id, client, utc
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record_index FROM g WHERE NOT (s1 > 6 AND s2 > 6)),
      runs AS (SELECT *, count(*) OVER (PARTITION BY record_index) AS record_length FROM n)"""


def long_runs(t, min_rows: int = runs.MIN_RUN):
    return runs.min_run_length(runs.continuous_runs(t.f1_long), min_rows)


@query(
    "dedup_keep_first",
    f"""SELECT {ROWS}, client, foc_me FROM (SELECT *, row_number() OVER (PARTITION BY ship_id, client, utc
        ORDER BY {ALL_F2}) AS rn FROM f2_leg) WHERE rn = 1""",
)
def _(t):
    return clean.keep_first(t.f2_leg, ["ship_id", "client", "utc"]).select(*ROW, "client", "foc_me")


@query(
    "duplicate_rows",
    f"""SELECT {ROWS}, client, foc_me FROM (SELECT *, row_number() OVER (PARTITION BY ship_id, utc
        ORDER BY {ALL_F2}) AS rn FROM f2_leg) WHERE rn > 1""",
)
def _(t):
    rank = [c.strip() for c in ALL_F2.split(",")]
    return clean.duplicate_rows(t.f2_leg, ["ship_id", "utc"], rank).select(*ROW, "client", "foc_me")


@query("gap_hours", f"WITH {gaps_sql('f1_leg_events')} SELECT event_id, {r('s1')} AS s1, {r('s2')} AS s2 FROM g")
def _(t):
    return runs.gap_hours(t.f1_leg_events).select("event_id", rc("s1").alias("s1"), rc("s2").alias("s2"))


CLASS_SQL = """CASE WHEN s1 > 6 AND s2 > 6 THEN 'isolated' WHEN s1 > 6 THEN 'start'
                    WHEN s2 > 6 THEN 'end' ELSE 'inner' END"""


@query("point_class", f"WITH {gaps_sql('f1_leg_events')} SELECT event_id, {CLASS_SQL} AS point_class FROM g")
def _(t):
    return runs.point_class(t.f1_leg_events).select("event_id", "point_class")


@query(
    "continuous_runs",
    f"WITH {runs_sql('f1_leg_events')} SELECT event_id, ship_id, client, utc, record_index, record_length FROM runs",
)
def _(t):
    return runs.continuous_runs(t.f1_leg_events).select(
        "event_id", "ship_id", "client", "utc", "record_index", "record_length"
    )


@query(
    "min_run_length",
    f"WITH {runs_sql('f1_long')} SELECT event_id, record_index, record_length FROM runs WHERE record_length >= 56",
)
def _(t):
    return long_runs(t).select("event_id", "record_index", "record_length")


@query(
    "low_fuel_flag",
    f"""WITH {runs_sql('f1_long')} SELECT event_id, record_index,
        foc_me < 0.15E0 * max(foc_me) OVER (PARTITION BY record_index) AS foc_too_small FROM runs WHERE record_length >= 56""",
)
def _(t):
    return runs.low_fuel_flag(stage(long_runs(t))).select("event_id", "record_index", "foc_too_small")


@query(
    "drop_low_fuel_runs",
    f"""WITH {runs_sql('f1_leg_events')}, f AS (SELECT *, min(foc_me) OVER (PARTITION BY record_index) <
          0.15E0 * max(foc_me) OVER (PARTITION BY record_index) AS bad FROM runs WHERE record_length >= 3)
        SELECT event_id, record_index, foc_me FROM f WHERE NOT bad""",
)
def _(t):
    found = stage(runs.min_run_length(runs.continuous_runs(t.f1_leg_events), 3))
    return runs.drop_low_fuel_runs(found).select("event_id", "record_index", "foc_me")


STEP_V1 = "coalesce(abs((foc_me - lead(foc_me) OVER w) / nullif(foc_me + 1, 0)), 0)"
STEP_V2 = "coalesce(abs((foc_me - lead(foc_me) OVER w) / nullif(foc_me, 0) * 100), 0)"


@query(
    "fuel_step_change",
    f"""WITH {runs_sql('f1_long')} SELECT event_id, record_index, {r(STEP_V1)} AS change_v1, {r(STEP_V2)} AS change_v2
        FROM runs WHERE record_length >= 56 WINDOW w AS (PARTITION BY record_index ORDER BY utc)""",
)
def _(t):
    found = stage(long_runs(t))
    v1 = runs.fuel_step_change(found, version=1).withColumnRenamed("foc_diff", "change_v1")
    both = runs.fuel_step_change(v1, version=2).withColumnRenamed("foc_diff", "change_v2")
    return rounded(both.select("event_id", "record_index", "change_v1", "change_v2"), ["change_v1", "change_v2"])


@query(
    "run_fuel_ok",
    f"""WITH {runs_sql('f1_leg_events')}, s AS (SELECT *, {STEP_V1} AS step FROM runs WHERE record_length >= 3
            WINDOW w AS (PARTITION BY record_index ORDER BY utc)),
          b AS (SELECT record_index, min(foc_me) < 0.15E0 * max(foc_me) OR max(step) > 2 AS bad FROM s GROUP BY record_index)
        SELECT event_id, record_index, NOT bad AS is_foc_ok FROM s JOIN b USING (record_index)""",
)
def _(t):
    found = stage(runs.min_run_length(runs.continuous_runs(t.f1_leg_events), 3))
    return runs.run_fuel_ok(found).select("event_id", "record_index", "is_foc_ok")


@query(
    "run_change_band",
    f"""WITH {runs_sql('f1_leg_events')}, s AS (SELECT *, {STEP_V2} AS step FROM runs WHERE record_length >= 3
            WINDOW w AS (PARTITION BY record_index ORDER BY utc)),
          b AS (SELECT record_index FROM s GROUP BY record_index HAVING max(step) BETWEEN 1 AND 100)
        SELECT event_id, record_index, {r('step')} AS foc_diff FROM s JOIN b USING (record_index)""",
)
def _(t):
    found = stage(runs.min_run_length(runs.continuous_runs(t.f1_leg_events), 3))
    return rounded(runs.run_change_band(found).select("event_id", "record_index", "foc_diff"), ["foc_diff"])


@query("voyage_numbering", f"WITH {NUMBERED} SELECT ship_id, dep_utc, arr_utc, rout_id FROM v")
def _(t):
    return voyages.number_voyages(t.f4_voyage)


@query(
    "voyage_unpivot_check",
    f"""WITH {NUMBERED}, e AS (SELECT ship_id, rout_id, 'dep_utc' AS variable, dep_utc AS utc FROM v
          UNION ALL SELECT ship_id, rout_id, 'arr_utc', arr_utc FROM v),
        p AS (SELECT *, lag(variable) OVER (PARTITION BY ship_id ORDER BY utc, variable, rout_id) AS pv FROM e)
        SELECT ship_id, rout_id, variable, utc FROM p WHERE coalesce(pv, 'arr_utc') = variable""",
)
def _(t):
    return voyages.alternation_violations(stage(voyages.number_voyages(t.f4_voyage), "voyages"))


@query(
    "run_representatives",
    f"""WITH {runs_sql('f1_leg_events')} SELECT record_index, any_value(ship_id) AS ship_id, any_value(client) AS client,
          min(utc) AS start_utc, max(utc) AS end_utc, count(*) AS record_length FROM runs GROUP BY record_index
        ORDER BY record_length DESC, record_index""",
)
def _(t):
    table = runs.run_table(runs.continuous_runs(t.f1_leg_events))
    return table.orderBy(F.col("record_length").desc(), "record_index")


SPLIT_SQL = f"""c AS (SELECT *, row_number() OVER (PARTITION BY ship_id ORDER BY {ORDERS}) AS pos,
        row_number() OVER (ORDER BY ship_id) - 1 AS i FROM f2_leg),
      a AS (SELECT ship_id, count(*) AS n, count(*) FILTER (WHERE i % 5 = 4) AS n_test FROM c GROUP BY ship_id),
      d AS (SELECT c.*, n, n_test FROM c JOIN a USING (ship_id)),
      e AS (SELECT *, row_number() OVER (ORDER BY ship_id) - 1 AS i2 FROM d WHERE pos <= n - n_test),
      b AS (SELECT ship_id, count(*) FILTER (WHERE i2 % 6 = 5) AS n_val FROM e GROUP BY ship_id),
      split AS (SELECT d.*, CASE WHEN pos > n - n_test THEN 'test' WHEN pos > n - n_test - n_val THEN 'val' ELSE 'train' END AS type
        FROM d JOIN b USING (ship_id))"""


def split_f2(t):
    """The fixture with its last-fold split; one row per day and ship, so buckets are months."""
    return splits.split_last_fold(t.f2_leg, ORDER, bucket_hours=24 * 30)


@query("split_last_fold", f"WITH {SPLIT_SQL} SELECT {ROWS}, type FROM split")
def _(t):
    return split_f2(t).select(*ROW, "type")


@query(
    "split_time_cut",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY ship_id ORDER BY {ORDERS}) AS pos,
          count(*) OVER (PARTITION BY ship_id) AS n FROM f2_leg)
        SELECT {ROWS}, CASE WHEN pos > n - ceil(n * 0.25E0) THEN 'test' ELSE 'train' END AS type FROM c""",
)
def _(t):
    return splits.split_time_cut(t.f2_leg, ORDER, 0.25, bucket_hours=24 * 30).select(*ROW, "type")


@query(
    "split_exact",
    """SELECT client, count(*) AS n_rows, CAST(ceil(count(*) * 0.2E0) AS BIGINT) AS n_test FROM f2_leg GROUP BY client""",
)
def _(t):
    """Random split of exact size in each stratum."""
    typed = splits.split_exact(t.f2_leg, ALL_KEYS, 0.2, ["client"])
    return typed.groupBy("client").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("type") == "test").alias("n_test"))


@query(
    "split_exact_pooled",
    "SELECT count(*) AS n_rows, CAST(ceil(count(*) * 0.25E0) AS BIGINT) AS n_test FROM f2_leg",
)
def _(t):
    typed = splits.split_exact(t.f2_leg, ALL_KEYS, 0.25, seed=7)
    return typed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("type") == "test").alias("n_test"))
