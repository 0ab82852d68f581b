"""Sorting, top-k, slices and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, clean, evaluate, runs, splits
from .filters import ROW, ROWS
from .joins import MIN_ROWS
from .registry import query, r, rc
from .series import SPLIT_SQL, gaps_sql, split_f2


@query(
    "top5_ships",
    f"""SELECT {ROWS} FROM f2_leg WHERE ship_id IN
        (SELECT ship_id FROM f2_leg GROUP BY ship_id ORDER BY count(*) DESC, ship_id LIMIT 5)""",
)
def _(t):
    legs = t.f2_leg
    top = audit.count_by(legs, ["ship_id"]).orderBy(F.col("n_rows").desc(), "ship_id").limit(5).select("ship_id")
    # five ids at most
    return legs.join(F.broadcast(top), "ship_id", "left_semi").select(*ROW)


@query("sort_keys", f"SELECT {ROWS}, client FROM f2_leg ORDER BY ship_id, client, utc, l_orderkey, l_linenumber")
def _(t):
    return t.f2_leg.select(*ROW, "client").orderBy("ship_id", "client", "utc", "l_orderkey", "l_linenumber")


@query(
    "topk_gaps",
    f"""WITH d AS (SELECT DISTINCT ship_id, client, utc FROM f2_leg), {gaps_sql('d')}
        SELECT {r('s1')} AS gap, count(*) AS n_rows FROM g GROUP BY gap ORDER BY n_rows DESC, gap LIMIT 20""",
)
def _(t):
    once = t.f2_leg.select("ship_id", "client", "utc").distinct()
    gaps = runs.gap_hours(once, bucket_hours=24 * 30).select(rc("s1").alias("gap"))
    return audit.count_by(gaps, ["gap"]).orderBy(F.col("n_rows").desc(), "gap").limit(20)


@query(
    "worst_errors",
    f"""SELECT record_index, ship_id, utc, tw_speed, {r('(tw_speed - pred_tw_speed) / nullif(tw_speed, 0)')} AS error
        FROM f5_prediction ORDER BY error, record_index, ship_id, utc, tw_speed LIMIT 50""",
)
def _(t):
    res = evaluate.residuals(t.f5_prediction, "tw_speed", "pred_tw_speed").withColumn("error", rc("error"))
    return res.select("record_index", "ship_id", "utc", "tw_speed", "error").orderBy(
        "error", "record_index", "ship_id", "utc", "tw_speed"
    ).limit(50)


@query(
    "worst_runs",
    f"""SELECT record_index, {r('avg(abs(tw_speed - pred_tw_speed))')} AS mae FROM f5_prediction WHERE type = 'test'
        GROUP BY record_index ORDER BY mae DESC, record_index DESC LIMIT 20""",
)
def _(t):
    by_run = evaluate.metrics(t.f5_prediction.where("type = 'test'"), ["record_index"], "tw_speed", "pred_tw_speed", ["mae"])
    tidy = by_run.select("record_index", rc("mae").alias("mae"))
    return tidy.orderBy(F.col("mae").desc(), F.col("record_index").desc()).limit(20)


@query(
    "rank_slice",
    f"""WITH m AS (SELECT record_index, {r('avg(abs(tw_speed - pred_tw_speed))')} AS mae FROM f5_prediction WHERE type = 'test'
          GROUP BY record_index)
        SELECT record_index, mae FROM m ORDER BY mae, record_index LIMIT 50 OFFSET 50""",
)
def _(t):
    by_run = evaluate.metrics(t.f5_prediction.where("type = 'test'"), ["record_index"], "tw_speed", "pred_tw_speed", ["mae"])
    return by_run.select("record_index", rc("mae").alias("mae")).orderBy("mae", "record_index").offset(50).limit(50)


@query(
    "union_all",
    """SELECT ship_id, utc, foc_me FROM f2_leg UNION ALL SELECT ship_id, utc, foc_me FROM f1_leg_events""",
)
def _(t):
    cols = ["ship_id", "utc", "foc_me"]
    return t.f2_leg.select(*cols).unionByName(t.f1_leg_events.select(*cols))


@query(
    "except_keys",
    f"""SELECT ship_id FROM f3_register EXCEPT
        SELECT ship_id FROM f2_leg GROUP BY ship_id HAVING count(*) >= {MIN_ROWS}""",
)
def _(t):
    return t.f3_register.select("ship_id").subtract(clean.long_history(t.f2_leg, MIN_ROWS))


@query(
    "split_disjoint",
    f"""WITH {SPLIT_SQL}, k AS (SELECT ship_id, utc, bool_or(type = 'train') AS a, bool_or(type = 'val') AS b,
          bool_or(type = 'test') AS c FROM split GROUP BY ship_id, utc)
        SELECT count(*) FILTER (WHERE a AND b) AS train_val, count(*) FILTER (WHERE a AND c) AS train_test,
          count(*) FILTER (WHERE b AND c) AS val_test FROM k""",
)
def _(t):
    # rows of one ship with equal times may fall on both sides of a cut, so this is not trivially zero
    return splits.shared_keys(split_f2(t), ["ship_id", "utc"])


@query("distinct_values", "SELECT DISTINCT ship_id, client FROM f2_leg")
def _(t):
    return t.f2_leg.select("ship_id", "client").distinct()
