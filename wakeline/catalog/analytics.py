"""Outliers, classes, scaling, regression and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..functions.performance import cube
from ..operators import classes, clean, dense, evaluate, outliers, ridge, scaling
from ..operators.sized import small
from ..plans.features import RATINGS, add_components, add_ratios, feature_table, legacy_features, outlier_features, pooled_table
from ..schema import FEATURE_SETS, FEATURES, MEASURED, SCALED_FEATURES, SHIP_FEATURES
from ..session import discard, stage
from .filters import ROW, ROWS, rated
from .physics import CRNT_L, FEATURE_SQL, ID, IDS, KW, LEGACY_SQL, RATED_F2
from .registry import query, r, rc, rounded
from .series import SPLIT_SQL, split_f2

def knn_sql(points: str, cols: list[str]) -> str:
    """CTE ``s``: the points with ``score``, the distance to the k-th nearest other row of the ship, k = min(100, int(n / 10)).

    Each ship's points are one list; a row sorts its own distances to them, of which its own zero is the first.
    """
    packed = ", ".join(f"'{c}': {c}" for c in cols)
    d2 = " + ".join(f"(q.{c} - {c}) * (q.{c} - {c})" for c in cols)
    return f"""p AS ({points}), g AS (SELECT ship_id AS gid, list({{{packed}}}) AS qs, CAST(least(100, floor(count(*) * 0.1)) AS BIGINT) AS k
        FROM p GROUP BY ship_id),
      s AS (SELECT p.*, CASE WHEN k >= 1 THEN sqrt(list_sort(list_transform(qs, lambda q: {d2}))[k + 1]) END AS score
            FROM p JOIN g ON ship_id = gid)"""


NORM_POINTS = f"""SELECT {IDS}, ship_id, (rpm / rpm_at_mcr) * (rpm / rpm_at_mcr) * (rpm / rpm_at_mcr) AS x,
    foc_me / {KW} AS y, (og_speed - {CRNT_L}) / speed_at_mcr AS z FROM {RATED_F2} WHERE power_at_mcr IS NOT NULL"""
RAW_POINTS = f"SELECT {IDS}, ship_id, og_speed AS x, rpm AS y, foc_me AS z FROM f2_leg"


@query(
    "knn_outlier_score",
    f"WITH {knn_sql(NORM_POINTS, ['x', 'y', 'z'])} SELECT {IDS}, ship_id, {r('score')} AS outlier_score FROM s",
)
def _(t):
    return norm_scores(t).select(*ID, "ship_id", rc("outlier_score").alias("outlier_score"))


@query(
    "knn_outlier_1d",
    f"""WITH {knn_sql(f"SELECT {IDS}, ship_id, l_extendedprice AS x FROM f2_leg", ['x'])}
        SELECT {IDS}, ship_id, {r('score', 4)} AS price_score FROM s""",
)
def _(t):
    scored = outliers.knn_score_1d(t.f2_leg, "l_extendedprice", out="price_score")
    return scored.select(*ID, "ship_id", rc("price_score", 4).alias("price_score"))


@query(
    "outlier_label",
    """SELECT l_orderkey, l_linenumber, l_partkey, ship_id, l_extendedprice, CAST(l_extendedprice >
         quantile_cont(l_extendedprice, 0.9) OVER (PARTITION BY ship_id) AS INTEGER) AS outlier_label FROM f2_leg""",
)
def _(t):
    labelled = outliers.outlier_label(t.f2_leg, score="l_extendedprice")
    return labelled.select("l_orderkey", "l_linenumber", "l_partkey", "ship_id", "l_extendedprice", "outlier_label")


# the joint-score limit, on the fixture's coarser value grid
JOINT_LIMIT = 8.0


def raw_scores(t):
    return outliers.knn_score(t.f2_leg, ["og_speed", "rpm", "foc_me"])


@query(
    "outlier_filter",
    f"WITH {knn_sql(RAW_POINTS, ['x', 'y', 'z'])} SELECT {IDS}, ship_id FROM s WHERE score < {JOINT_LIMIT}",
)
def _(t):
    return raw_scores(t).where(F.col("outlier_score") < JOINT_LIMIT).select(*ID, "ship_id")


def norm_scores(t):
    legs = outlier_features(t.f2_leg, t.f3_register).where("norm_foc_me IS NOT NULL")
    return outliers.knn_score(legs, ["norm_rpm3", "norm_foc_me", "norm_tw_speed"])


def _labels_sql(contamination: float) -> str:
    return f"""WITH {knn_sql(NORM_POINTS, ['x', 'y', 'z'])}, n AS (SELECT {IDS}, ship_id, {r('score')} AS score FROM s)
        SELECT {IDS}, ship_id, CAST(score > quantile_cont(score, {1 - contamination}) OVER (PARTITION BY ship_id) AS INTEGER) AS outlier_label FROM n"""


@query("outlier_label_score", _labels_sql(0.06))
def _(t):
    """Labels of the joint score at the earlier contamination; compared after rounding, as both engines sum alike."""
    rows = stage(rounded(norm_scores(t).select(*ID, "ship_id", "outlier_score"), ["outlier_score"]), "scores")
    return outliers.outlier_label(rows, contamination=0.06).drop("outlier_score")


@query("outlier_filter_label", f"SELECT {IDS}, ship_id FROM ({_labels_sql(0.1)}) WHERE outlier_label = 0")
def _(t):
    """Rows that the joint score does not label, the rule in use."""
    rows = stage(rounded(norm_scores(t).select(*ID, "ship_id", "outlier_score"), ["outlier_score"]), "scores")
    return outliers.outlier_label(rows, contamination=0.1).where("outlier_label = 0").select(*ID, "ship_id")


# limits of the three single scores, on the fixture's values
SINGLE_LIMITS = {"l_extendedprice": 5900.0, "sig_ht": 0.35, "foc_me": 3.5}


def _singles_sql() -> str:
    scored = []
    for c in SINGLE_LIMITS:
        scored.append(f"s_{c} AS (WITH {knn_sql(f'SELECT {IDS}, ship_id, {c} AS x FROM f2_leg', ['x'])} SELECT {IDS}, ship_id, score FROM s)")
    keep = " AND ".join(f"{r(f's_{c}.score')} < {limit}" for c, limit in SINGLE_LIMITS.items())
    first, *others = [f"s_{c}" for c in SINGLE_LIMITS]
    joined = " ".join(f"JOIN {o} USING ({IDS}, ship_id)" for o in others)
    return f"WITH {', '.join(scored)} SELECT {IDS}, ship_id FROM {first} {joined} WHERE {keep}"


@query("outlier_filter_1d", _singles_sql())
def _(t):
    """Rows within the limit on each of three single-column scores."""
    rows = t.f2_leg.select(*ID, "ship_id", *[c for c in SINGLE_LIMITS if c not in ID])
    return outliers.single_filter(rows, SINGLE_LIMITS).select(*ID, "ship_id")


@query(
    "outlier_audit",
    f"""WITH {knn_sql(RAW_POINTS, ['x', 'y', 'z'])}
        SELECT {r('count(*) FILTER (WHERE score >= 1) / count(*)')} AS share_ge_1,
          {r('count(*) FILTER (WHERE score >= 3) / count(*)')} AS share_ge_3,
          {r('min(score)')} AS min_score, {r('max(score)')} AS max_score FROM s""",
)
def _(t):
    report = outliers.outlier_audit(stage(raw_scores(t).select("outlier_score"), "scores"))
    return rounded(report, report.columns)


def _pca_sql() -> str:
    """Closed form for three columns: roots of the characteristic polynomial, each vector the largest cross product of two
    rows of (matrix - root)."""

    def vector(k: int) -> str:
        rows = [(f"1 - w{k}", "a", "b"), ("a", f"1 - w{k}", "c"), ("b", "c", f"1 - w{k}")]
        cross = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            (p, q, s), (u, v, w) = rows[i], rows[j]
            cross.append(f"[({q}) * ({w}) - ({s}) * ({v}), ({s}) * ({u}) - ({p}) * ({w}), ({p}) * ({v}) - ({q}) * ({u})]")
        return f"[{', '.join(cross)}] AS x{k}"

    unit = lambda k: f"""list_transform(v{k}, lambda e: e / sqrt(list_dot_product(v{k}, v{k}))
        * CASE WHEN list_max(v{k}) >= -list_min(v{k}) THEN 1 ELSE -1 END) AS u{k}"""  # noqa: E731
    pick = lambda k: f"""list_filter(x{k}, lambda e: list_dot_product(e, e) =
        list_max(list_transform(x{k}, lambda f: list_dot_product(f, f))))[1] AS v{k}"""  # noqa: E731
    apart = lambda k: f"sqrt((z1 - u{k}[1]) * (z1 - u{k}[1]) + (z2 - u{k}[2]) * (z2 - u{k}[2]) + (z3 - u{k}[3]) * (z3 - u{k}[3]))"
    return f"""WITH n AS ({NORM_POINTS}),
      m AS (SELECT ship_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz,
        corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c FROM n GROUP BY ship_id),
      e AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS h, a * b * c AS det FROM m),
      o AS (SELECT *, acos(greatest(-1, least(1, det / (h * h * h)))) / 3 AS phi FROM e),
      l AS (SELECT *, 1 + 2 * h * cos(phi) AS w1, 1 + 2 * h * cos(phi - 2 * pi() / 3) AS w2 FROM o),
      t AS (SELECT *, {vector(1)}, {vector(2)} FROM l),
      v AS (SELECT *, {pick(1)}, {pick(2)} FROM t),
      u AS (SELECT *, {unit(1)}, {unit(2)} FROM v),
      s AS (SELECT n.*, (x - mx) / sx AS z1, (y - my) / sy AS z2, (z - mz) / sz AS z3, w1, w2, u1, u2 FROM n JOIN u USING (ship_id))
      SELECT {IDS}, ship_id, {r(f'{apart(1)} / (w1 / 3) + {apart(2)} / (w2 / 3)', 4)} AS outlier_score FROM s"""


@query("pca_outlier", _pca_sql())
def _(t):
    """Score by the ship's own two leading components."""
    legs = outlier_features(t.f2_leg, t.f3_register).where("norm_foc_me IS NOT NULL")
    scored = outliers.pca_outlier(legs, ["norm_rpm3", "norm_foc_me", "norm_tw_speed"])
    return scored.select(*ID, "ship_id", rc("outlier_score", 4).alias("outlier_score"))


def all_classes(t):
    return classes.ship_classes(clean.register_clean(t.f3_register.drop("label")), k=5)


@query("ship_classes")
def _(t):
    return all_classes(t).select("ship_id", "ship_type", "dwt", "gt", "label", "n_classes")


@query(
    "class_fit",
    """SELECT ship_type, count(*) AS n_ships, CAST(0 AS BIGINT) AS n_misplaced FROM f3_register
       WHERE power_at_mcr IS NOT NULL AND depth > 0 GROUP BY ship_type""",
)
def _(t):
    """Every complete ship has a class, and none is nearer to the mean of another one."""
    return classes.misplaced(all_classes(t))


SCALED = ["draft_aft", "sig_ht", "sea_ht", "wind_v", "crnt_v"]


def _scaled_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
    out = ", ".join(
        f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in SCALED
    )
    return f"""WITH {SPLIT_SQL}, st AS (SELECT {stats} FROM split WHERE type <> 'test')
        SELECT {ROWS}, type, {out} FROM split, st"""


@query("standardize_fit_apply", _scaled_sql())
def _(t):
    # the split feeds both the fit and the rows
    typed = stage(split_f2(t).select(*ROW, "type", *SCALED), "split")
    return rounded(scaling.standardize_splits(typed, SCALED), SCALED)


@query("inverse_scale", f"SELECT {ROWS}, {r('foc_me')} AS foc_back FROM f2_leg")
def _(t):
    legs = t.f2_leg
    z = scaling.standardize(legs.withColumn("z", F.col("foc_me")), ["z"])
    return scaling.unscale(z, "z", legs, "foc_me", "foc_back").select(*ROW, rc("foc_back").alias("foc_back"))


RIDGE_FEATURES = [
    "draft_aft", "sig_ht", "crnt_L", "crnt_T", "wind_L", "wind_T", "sea_ht_L", "sea_ht_T", "swl_ht_L", "swl_ht_T",
    "normalized_rpm", "og_speed",
]
MONTH = 24 * 30


def ridge_rows(t):
    legs = clean.missing_ge(t.f2_leg, ["wind_u", "crnt_u"])
    table = feature_table(legs, t.f3_register, keep=[*ROW, "client", "rpm"])
    return table.select(*ROW, "client", *RIDGE_FEATURES, "foc_me").na.drop(subset=["normalized_rpm"])


ROW_ORDER = ["utc", "client", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@query("ridge_baseline")
def _(t):
    rows = stage(ridge.with_folds(ridge_rows(t), ROW_ORDER, bucket_hours=MONTH), "ridge-folds")
    models = stage(ridge.fit_ridge(rows, RIDGE_FEATURES, "foc_me"), "ridge-models")
    tested = ridge.predict(rows.where("fold = -1"), models, RIDGE_FEATURES)
    errors = evaluate.metrics(tested, ["ship_id"], "foc_me", "pred")
    return rounded(errors.join(models.select("ship_id", "alpha"), "ship_id"), evaluate.METRICS, 4)


@query("ridge_coefficients")
def _(t):
    rows = stage(ridge.with_folds(ridge_rows(t), ROW_ORDER, bucket_hours=MONTH), "ridge-folds")
    table = ridge.ranked_coefficients(ridge.fit_ridge(rows, RIDGE_FEATURES, "foc_me"), RIDGE_FEATURES)
    return rounded(table, ["coef", "coef_abs"], 4)


def _single_sql() -> str:
    """Ridge on one feature in closed form: CTEs up to ``m``, one model a ship."""
    alphas = ", ".join(map(str, ridge.ALPHAS))
    return f"""b AS (SELECT * FROM (SELECT ship_id, {", ".join(ROW_ORDER)}, rpm / nullif(rpm_at_mcr, 0) AS x, foc_me AS y FROM {RATED_F2}
            WHERE NOT (coalesce(wind_u >= 9000, FALSE) OR coalesce(crnt_u >= 9000, FALSE))) WHERE x IS NOT NULL),
      p AS (SELECT *, row_number() OVER (PARTITION BY ship_id ORDER BY {", ".join(ROW_ORDER)}) - 1 AS i, count(*) OVER (PARTITION BY ship_id) AS n FROM b),
      t AS (SELECT *, CAST(n - ceil(n * {ridge.TEST_SHARE}) AS BIGINT) AS train FROM p),
      e AS (SELECT *, train // {ridge.FOLDS} AS small, train % {ridge.FOLDS} AS extra FROM t),
      f AS (SELECT *, CASE WHEN i < extra * (small + 1) THEN i // (small + 1) ELSE extra + (i - extra * (small + 1)) // nullif(small, 0) END AS fold
            FROM e WHERE i < train),
      st AS (SELECT ship_id, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM f GROUP BY ship_id),
      z AS (SELECT f.ship_id, fold, (x - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END AS u, (y - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END AS v FROM f JOIN st USING (ship_id)),
      q AS (SELECT ship_id, fold, count(*) AS n, sum(u) AS u, sum(v) AS v, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv FROM z GROUP BY ship_id, fold),
      a AS (SELECT ship_id, sum(n) AS n, sum(u) AS u, sum(v) AS v, sum(uu) AS uu, sum(uv) AS uv FROM q GROUP BY ship_id),
      o AS (SELECT q.*, alpha, a.n - q.n AS rn, a.u - q.u AS ru, a.v - q.v AS rv, a.uu - q.uu AS ruu, a.uv - q.uv AS ruv
            FROM q JOIN a USING (ship_id), (SELECT unnest([{alphas}]) AS alpha)),
      w AS (SELECT *, (ruv - ru * rv / rn) / (ruu - ru * ru / rn + alpha) AS w FROM o WHERE rn > 0),
      d AS (SELECT *, (rv - w * ru) / rn AS c FROM w),
      r AS (SELECT ship_id, alpha, 1 - (vv + w * w * uu + n * c * c - 2 * w * uv - 2 * c * v + 2 * w * c * u) / nullif(vv - v * v / n, 0) AS r2 FROM d),
      k AS (SELECT ship_id, alpha, avg(r2) AS cv FROM r GROUP BY ship_id, alpha),
      g AS (SELECT ship_id, arg_max(alpha, cv) AS alpha, max(cv) AS cv_r2 FROM k GROUP BY ship_id),
      h AS (SELECT ship_id, alpha, cv_r2, a.uv / (a.uu + alpha) * sy / CASE WHEN sx = 0 THEN 1 ELSE sx END AS coef, mx, my
            FROM g JOIN a USING (ship_id) JOIN st USING (ship_id)),
      m AS (SELECT ship_id, alpha, cv_r2, coef, my - coef * mx AS intercept FROM h)"""


def single_models(t):
    """Rows with folds, and ridge models on normalised engine speed alone."""
    rows = stage(ridge.with_folds(ridge_rows(t), ROW_ORDER, bucket_hours=MONTH), "ridge-folds")
    return rows, stage(ridge.fit_ridge(rows, ["normalized_rpm"], "foc_me"), "ridge-models")


@query("ridge_single", f"WITH {_single_sql()} SELECT ship_id, alpha, {r('cv_r2', 5)} AS cv_r2, {r('coef', 4)} AS coef, {r('intercept', 4)} AS intercept FROM m")
def _(t):
    """Cross-validated ridge with one feature: penalty, mean fold R2 and model per ship."""
    _rows, models = single_models(t)
    out = models.select("ship_id", "alpha", rc("cv_r2", 5).alias("cv_r2"), F.col("coef")[0].alias("coef"), "intercept")
    return rounded(out, ["coef", "intercept"], 4)


@query(
    "what_if_single",
    f"""WITH {_single_sql()}, ends AS (SELECT ship_id, min(x) AS lo, max(x) AS hi FROM b GROUP BY ship_id),
          s AS (SELECT ship_id, step, lo + (hi - lo) * step / 49.0E0 AS x FROM ends CROSS JOIN (SELECT CAST(unnest(range(50)) AS INTEGER) AS step))
        SELECT ship_id, step, {r('x')} AS normalized_rpm, {r('intercept + coef * x', 4)} AS pred FROM s JOIN m USING (ship_id)""",
)
def _(t):
    """The one-feature models scored over each ship's range of normalised engine speed."""
    rows, models = single_models(t)
    grid = ridge.sweep_grid(rows, "normalized_rpm")
    scored = ridge.predict(grid, models, ["normalized_rpm"])
    return rounded(rounded(scored.select("ship_id", "step", "normalized_rpm", "pred"), ["normalized_rpm"]), ["pred"], 4)


Y, P = "tw_speed", "pred_tw_speed"
MAE = f"avg(abs({Y} - {P}))"
RMSE = f"sqrt(avg(({Y} - {P}) * ({Y} - {P})))"
MAPE = f"avg(abs(({Y} - {P}) / nullif({Y}, 0))) * 100"
R2 = f"1 - avg(({Y} - {P}) * ({Y} - {P})) / nullif(var_pop({Y}), 0)"


@query(
    "regression_metrics",
    f"""SELECT type, count(*) AS n_rows, {r(MAE)} AS mae, {r(RMSE)} AS rmse, {r(R2)} AS r2 FROM f5_prediction GROUP BY type""",
)
def _(t):
    return rounded(evaluate.metrics(t.f5_prediction, ["type"], Y, P, ["mae", "rmse", "r2"]), ["mae", "rmse", "r2"])


@query("mape", f"SELECT type, {r(MAPE)} AS mape FROM f5_prediction GROUP BY type")
def _(t):
    return rounded(evaluate.metrics(t.f5_prediction, ["type"], Y, P, ["mape"]).drop("n_rows"), ["mape"])


BY_RUN = f"""SELECT type, record_index, count(*) AS n_rows, {r(MAE)} AS mae, {r(RMSE)} AS rmse, {r(MAPE)} AS mape
    FROM f5_prediction GROUP BY type, record_index"""


@query("metrics_by_run", BY_RUN)
def _(t):
    return rounded(evaluate.metrics_by_run(t.f5_prediction), ["mae", "rmse", "mape"])


@query(
    "metrics_long",
    f"""WITH b AS (SELECT type, record_index, {MAE} AS mae, {RMSE} AS rmse, {MAPE} AS mape FROM f5_prediction GROUP BY type, record_index),
          l AS (SELECT type, 'mae' AS metric, mae AS error FROM b UNION ALL SELECT type, 'rmse', rmse FROM b
          UNION ALL SELECT type, 'mape', mape FROM b)
        SELECT type, metric, {r('min(error)')} AS low, {r('quantile_cont(error, 0.25)')} AS q1, {r('quantile_cont(error, 0.5)')} AS median,
          {r('quantile_cont(error, 0.75)')} AS q3, {r('max(error)')} AS high FROM l GROUP BY type, metric""",
)
def _(t):
    box = evaluate.box_stats(evaluate.metrics_long(evaluate.metrics_by_run(t.f5_prediction)))
    return rounded(box, ["low", "q1", "median", "q3", "high"])


@query(
    "metrics_by_class",
    f"""SELECT label, count(*) AS n_rows, {r(MAE)} AS mae, {r(RMSE)} AS rmse, {r(MAPE)} AS mape, {r(R2)} AS r2
        FROM f5_prediction LEFT JOIN (SELECT ship_id, label FROM f3_register) USING (ship_id) WHERE type = 'test' GROUP BY label""",
)
def _(t):
    return rounded(evaluate.metrics_by_class(t.f5_prediction, t.f3_register), evaluate.METRICS)


@query(
    "residuals",
    f"""SELECT ship_id, record_index, utc, {Y}, {r(f'{Y} - {P}')} AS residual, {r(f'({Y} - {P}) / nullif({Y}, 0)')} AS error,
          {r(f'abs(({Y} - {P}) / nullif({Y}, 0))')} AS abs_error FROM f5_prediction""",
)
def _(t):
    res = evaluate.residuals(t.f5_prediction, Y, P)
    cols = ["residual", "error", "abs_error"]
    return rounded(res.select("ship_id", "record_index", "utc", Y, *cols), cols)


@query(
    "residual_qq",
    f"""WITH x AS (SELECT ship_id, type, {r(f'{Y} - {P}')} AS residual FROM f5_prediction)
        SELECT type, residual, n_rows, {r('(cum - n_rows) / nullif(total - 1, 0)')} AS pct_rank FROM (
          SELECT type, residual, count(*) AS n_rows, sum(count(*)) OVER (PARTITION BY type ORDER BY residual) AS cum,
            sum(count(*)) OVER (PARTITION BY type) AS total FROM x GROUP BY type, residual)""",
)
def _(t):
    res = evaluate.residuals(t.f5_prediction, Y, P).select("type", rc("residual").alias("residual"))
    return rounded(evaluate.percent_rank_table(res, ["type"], "residual"), ["pct_rank"])


@query(
    "residual_normal_quantiles",
    f"""WITH x AS (SELECT type, {r(f'{Y} - {P}')} AS residual FROM f5_prediction),
          c AS (SELECT type, residual, count(*) AS n_rows, sum(count(*)) OVER (PARTITION BY type ORDER BY residual) AS upto,
            sum(count(*)) OVER (PARTITION BY type) AS total FROM x GROUP BY type, residual),
          f AS (SELECT type, avg(residual) AS m, stddev_pop(residual) AS s FROM x GROUP BY type)
        SELECT type, residual, n_rows, {r(normal.quantile_sql('(upto - n_rows + 1) / (total + 1)'))} AS normal_low,
          {r(normal.quantile_sql('upto / (total + 1)'))} AS normal_high, {r('(residual - m) / nullif(s, 0)')} AS standardised
        FROM c JOIN f USING (type)""",
)
def _(t):
    """Residuals against the normal distribution fitted to them, each different value once."""
    res = evaluate.residuals(t.f5_prediction, Y, P).select("type", rc("residual").alias("residual"))
    return rounded(evaluate.normal_quantile_table(res, ["type"], "residual"), ["normal_low", "normal_high", "standardised"])


@query(
    "assemble_results",
    f"""WITH {SPLIT_SQL}, w AS (SELECT *, {CRNT_L} AS crnt_l, og_speed / 20.0E0 AS pred_norm FROM split)
        SELECT {ROWS}, type, {r('og_speed - crnt_l')} AS tw_speed, {r('pred_norm * speed_at_mcr')} AS pred_tw_speed,
          {r('pred_norm * speed_at_mcr + crnt_l')} AS pred_og_speed
        FROM w LEFT JOIN (SELECT ship_id, speed_at_mcr FROM f3_register) USING (ship_id)""",
)
def _(t):
    table = feature_table(split_f2(t), t.f3_register, keep=[*ROW, "type"])
    # og_speed / 20 stands in for a model's normalised prediction
    predicted = table.withColumn("pred_normalized_tw_speed", F.col("og_speed") / 20.0)
    res = evaluate.assemble_results(predicted, t.f3_register)
    cols = ["tw_speed", "pred_tw_speed", "pred_og_speed"]
    return rounded(res.select(*ROW, "type", *cols), cols)


@query(
    "what_if_sweep",
    f"""SELECT ship_id, step, {r('lo + (hi - lo) * step / 49.0E0')} AS rpm FROM
        (SELECT ship_id, min(rpm) AS lo, max(rpm) AS hi FROM f2_leg GROUP BY ship_id)
        CROSS JOIN (SELECT CAST(unnest(range(50)) AS INTEGER) AS step)""",
)
def _(t):
    return rounded(ridge.sweep_grid(t.f2_leg), ["rpm"])


@query("what_if_scores")
def _(t):
    rows = stage(ridge.with_folds(ridge_rows(t), ROW_ORDER, bucket_hours=MONTH), "ridge-folds")
    models = stage(ridge.fit_ridge(rows, RIDGE_FEATURES, "foc_me"), "ridge-models")
    tested = rows.where("fold = -1")
    earliest = clean.leading(tested.select("ship_id", *ROW_ORDER, *RIDGE_FEATURES), ["ship_id"], ROW_ORDER[0])
    base = clean.keep_first(earliest, ["ship_id"], ROW_ORDER)
    scored = ridge.what_if(rows, base, models, RIDGE_FEATURES, col="normalized_rpm")
    return rounded(scored.select("ship_id", "step", "normalized_rpm", "pred"), ["normalized_rpm", "pred"], 4)


# the network of the fixture: smaller than the default, as its rows are fewer
NET = dense.Net(layers=((48, "relu", 0.0), (24, "relu", 0.0)), loss="mae", rate=0.004, rounds=14, patience=5, block_rows=2048)
POOLED = [*FEATURES, *SHIP_FEATURES]


def typed_rows(t):
    """The split's rows as measured: values of few digits, a third of the bytes of what is computed from them."""
    return stage(split_f2(t).select(*ROW, "client", "type", *[c for c in MEASURED if c not in ROW]), "typed")


def pooled_rows(t, typed=None):
    """Split rows of classified ships with their 27 scaled inputs; ratings as they are under their own names."""
    typed = typed_rows(t) if typed is None else typed
    table = feature_table(typed, small(t.f3_register.select("ship_id", *RATINGS)), keep=[*ROW, "client", "type"])
    return pooled_table(table, clean.register_clean(t.f3_register))


def dense_models(t):
    typed = typed_rows(t)
    rows = stage(pooled_rows(t, typed), "pooled")
    discard(typed)
    models, history = dense.fit_dense(rows, POOLED, "normalized_tw_speed", "label", ROW, NET)
    return rows, models, history


@query("dense_baseline")
def _(t):
    """Errors of the pooled network per class and split, and the round it was taken from."""
    rows, models, _ = dense_models(t)
    scored = dense.predict_dense(rows, models, POOLED, "label", NET, "pred")
    report = evaluate.metrics(scored, ["label", "type"], "normalized_tw_speed", "pred")
    return rounded(report.join(models.select(F.col("group").alias("label"), "round"), "label"), evaluate.METRICS, 4)


@query("dense_results")
def _(t):
    """Predictions of the pooled network in natural units, split by split."""
    rows, models, _ = dense_models(t)
    scored = dense.predict_dense(rows, models, POOLED, "label", NET, "pred_normalized_tw_speed").drop(*SHIP_FEATURES)
    legs = feature_table(t.f2_leg, t.f3_register, keep=ROW).select(*ROW, F.col("crnt_L").alias("crnt_knots"))
    knots = scored.drop("crnt_L").join(legs, ROW).withColumnRenamed("crnt_knots", "crnt_L")
    res = evaluate.assemble_results(knots, t.f3_register)
    cols = ["tw_speed", "pred_tw_speed", "pred_og_speed"]
    return rounded(res.select(*ROW, "label", "type", *cols), cols, 4)


@query("dense_what_if")
def _(t):
    """One test row of each ship scored by its class's network over the ship's range of normalised engine speed."""
    rows, models, _ = dense_models(t)
    base = clean.keep_first(rows.where("type = 'test'").select("label", *ROW_ORDER, "ship_id", *POOLED), ["ship_id"], ROW_ORDER)
    grid = ridge.swept(rows, base.select("ship_id", "label", *POOLED), "normalized_rpm")
    scored = dense.predict_dense(grid, models, POOLED, "label", NET, "pred")
    return rounded(scored.select("ship_id", "label", "step", "normalized_rpm", "pred"), ["normalized_rpm", "pred"], 4)


def _joint_sql() -> str:
    cols = ["draft_aft", "sig_ht", "sea_ht", "foc_me"]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    out = ", ".join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in cols)
    return f"WITH {SPLIT_SQL}, st AS (SELECT {stats} FROM split WHERE type = 'train') SELECT {ROWS}, type, {out} FROM split, st"


@query("standardize_joint", _joint_sql())
def _(t):
    """Features and target scaled together, fitted on the training rows."""
    typed = stage(split_f2(t).select(*ROW, "type", "draft_aft", "sig_ht", "sea_ht", "foc_me"), "split")
    out = scaling.standardize_joint(typed, ["draft_aft", "sig_ht", "sea_ht"], "foc_me")
    return rounded(out, ["draft_aft", "sig_ht", "sea_ht", "foc_me"])


def _register_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SHIP_FEATURES)
    out = ", ".join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in SHIP_FEATURES)
    return f"""WITH k AS (SELECT * FROM f3_register WHERE power_at_mcr IS NOT NULL AND depth > 0),
        st AS (SELECT label, {stats} FROM k GROUP BY label) SELECT ship_id, label, {out} FROM k JOIN st USING (label)"""


@query("standardize_register", _register_sql())
def _(t):
    """Register columns scaled over the ships of each class."""
    ships = clean.register_clean(t.f3_register).select("ship_id", "label", *SHIP_FEATURES)
    return rounded(scaling.standardize_by(ships, SHIP_FEATURES, ["label"]), SHIP_FEATURES)


def _pooled_sql() -> str:
    cols = [*SCALED_FEATURES, *SHIP_FEATURES]
    made = ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in [*FEATURES, "normalized_tw_speed"] if FEATURE_SQL.get(c, c) != c)
    z = lambda c, s: r(f"(w.{c} - {s}.m_{c}) / CASE WHEN {s}.s_{c} = 0 THEN 1 ELSE {s}.s_{c} END", 5)
    ship = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SHIP_FEATURES)
    rows = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED_FEATURES)
    return f"""WITH {SPLIT_SQL}, k AS (SELECT * FROM f3_register WHERE power_at_mcr IS NOT NULL AND depth > 0),
        w AS (SELECT *, {made} FROM (SELECT * FROM split JOIN (SELECT ship_id, label, {", ".join(SHIP_FEATURES)} FROM k) USING (ship_id))),
        sr AS (SELECT label, {rows} FROM w WHERE type <> 'test' GROUP BY label), ss AS (SELECT label, {ship} FROM k GROUP BY label)
        SELECT {", ".join("w." + c.strip() for c in ROWS.split(","))}, w.type, w.label,
          {", ".join(f"{z(c, 'sr' if c in SCALED_FEATURES else 'ss')} AS {c}" for c in cols)},
          {r("w.normalized_tw_speed", 5)} AS normalized_tw_speed
        FROM w JOIN sr USING (label) JOIN ss USING (label)"""


@query("pooled_features", _pooled_sql())
def _(t):
    """The data step of the pooled models: class ships only, three scalings."""
    cols = [*SCALED_FEATURES, *SHIP_FEATURES, "normalized_tw_speed"]
    return rounded(pooled_rows(t).select(*ROW, "type", "label", *cols), cols, 5)


@query(
    "polynomial_feats",
    f"""SELECT {ROWS}, {r('rpm * rpm * rpm')} AS rpm_3,
          {r('(rpm / nullif(rpm_at_mcr, 0)) * (rpm / nullif(rpm_at_mcr, 0)) * (rpm / nullif(rpm_at_mcr, 0))')} AS rpm_norm_3
        FROM {RATED_F2}""",
)
def _(t):
    legs = rated(t).withColumn("rpm_norm", F.try_divide("rpm", "rpm_at_mcr"))
    cubed = legs.withColumns({"rpm_3": cube("rpm"), "rpm_norm_3": cube("rpm_norm")})
    return rounded(cubed.select(*ROW, "rpm_3", "rpm_norm_3"), ["rpm_3", "rpm_norm_3"])


def _sets_sql() -> str:
    parts = []
    for name, cols in FEATURE_SETS.items():
        full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        parts.append(f"SELECT '{name}' AS feature_set, {len(cols)} AS n_cols, count(*) FILTER (WHERE {full}) AS n_complete FROM w")
    made = {**FEATURE_SQL, **LEGACY_SQL}
    made["trim"] = made.pop("trim_m")
    made = {c: sql for c, sql in made.items() if c != sql}
    cols = ", ".join(f"{sql} AS {c}" for c, sql in made.items())
    ship = ", ".join(dict.fromkeys(["ship_id", *SHIP_FEATURES, "date_built_year"]))
    rows = f"(SELECT * FROM f2_leg LEFT JOIN (SELECT {ship} FROM f3_register) USING (ship_id))"
    return f"WITH w AS (SELECT *, {cols} FROM {rows}) " + " UNION ALL ".join(parts)


@query("feature_sets", _sets_sql())
def _(t):
    """Rows that have every column of each named set; one pass for all sets."""
    joined = t.f2_leg.join(t.f3_register.drop("ship_type", "label"), "ship_id", "left")
    table = add_ratios(add_components(legacy_features(joined)))
    whole = {name: F.count_if(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in cols))) for name, cols in FEATURE_SETS.items()}
    one = table.agg(*[n.alias(name) for name, n in whole.items()])
    sets = [F.struct(F.lit(k).alias("feature_set"), F.lit(len(v)).alias("n_cols"), F.col(k).alias("n_complete")) for k, v in FEATURE_SETS.items()]
    return one.select(F.inline(F.array(*sets)))
