"""Aggregations and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, clean, density, evaluate, runs
from ..operators.quantiles import grouped_quantiles
from ..schema import REGISTER_NUMERIC
from ..session import stage
from .filters import DIRS, RATED, RATED_SQL, ROW, ROWS, WX, any_sql
from .joins import MIN_ROWS
from .registry import query, r, rc, rounded
from .series import CLASS_SQL, SPLIT_SQL, gaps_sql, long_runs, runs_sql, split_f2


@query("count_per_ship", "SELECT ship_id, count(*) AS n_rows FROM f2_leg GROUP BY ship_id ORDER BY n_rows DESC, ship_id")
def _(t):
    return audit.count_by(t.f2_leg, ["ship_id"]).orderBy(F.col("n_rows").desc(), "ship_id")


@query(
    "group_size_stats",
    f"""SELECT {r('avg(n)')} AS mean_rows, quantile_cont(n, 0.5) AS median_rows, min(n) AS min_rows
        FROM (SELECT count(*) AS n FROM f2_leg GROUP BY ship_id)""",
)
def _(t):
    return rounded(audit.group_size_stats(t.f2_leg), ["mean_rows"])


@query(
    "min_history_filter",
    f"""SELECT {ROWS} FROM f2_leg WHERE ship_id IN
        (SELECT ship_id FROM f2_leg GROUP BY ship_id HAVING count(*) >= {MIN_ROWS})""",
)
def _(t):
    return clean.min_history(t.f2_leg, MIN_ROWS).select(*ROW)


@query("distinct_clients", "SELECT ship_id, count(DISTINCT client) AS n_clients FROM f2_leg GROUP BY ship_id")
def _(t):
    return t.f2_leg.groupBy("ship_id").agg(F.count_distinct("client").alias("n_clients"))


@query(
    "dup_profile",
    """SELECT multiplicity, count(*) AS n_keys FROM (SELECT count(*) AS multiplicity FROM f2_leg
       GROUP BY ship_id, client, utc) GROUP BY multiplicity""",
)
def _(t):
    return audit.dup_profile(t.f2_leg, ["ship_id", "client", "utc"])


def per_column(test: str, cols, scale="* 100") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} {test}) / count(*) {scale} AS v FROM f2_leg" for c in cols
    )


@query(
    "missing_ratio",
    f"""WITH x AS ({per_column('>= 9000', WX)}), e AS ({per_column('= 9999', WX)})
        SELECT x.column_name, {r('x.v')} AS missing_pct, {r('e.v')} AS coded_pct FROM x JOIN e USING (column_name)
        ORDER BY missing_pct, column_name""",
)
def _(t):
    return rounded(audit.missing_ratio(t.f2_leg, WX), ["missing_pct", "coded_pct"]).orderBy("missing_pct", "column_name")


REGISTER = ["ship_id", "ship_type", *REGISTER_NUMERIC, "date_built_year", "label"]


@query(
    "null_counts",
    "SELECT column_name, n_null, "
    + r("n_null / n")
    + " AS null_share FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) AS n FROM f3_register"
        for c in REGISTER
    )
    + ")",
)
def _(t):
    return rounded(audit.null_counts(t.f3_register, REGISTER), ["null_share"])


@query(
    "dup_ratio_per_ship",
    f"""WITH k AS (SELECT ship_id, utc, count(*) AS n FROM f2_leg GROUP BY ship_id, utc)
        SELECT ship_id, CAST(sum(n) AS BIGINT) AS n_rows, {r('(sum(n) - count(*)) / sum(n) * 100')} AS dup_pct FROM k
        GROUP BY ship_id ORDER BY dup_pct DESC, ship_id""",
)
def _(t):
    table = audit.dup_ratio_per_ship(t.f2_leg, ["ship_id", "utc"])
    return rounded(table, ["dup_pct"]).orderBy(F.col("dup_pct").desc(), "ship_id")


@query(
    "missing_ratio_per_ship",
    f"""SELECT ship_id, count(*) AS n_rows, {r(f"count(*) FILTER (WHERE {any_sql('>= 9000')}) / count(*) * 100")} AS lost_pct
        FROM f2_leg GROUP BY ship_id ORDER BY lost_pct DESC, ship_id""",
)
def _(t):
    from ..operators.sized import any_of

    lost = any_of([F.coalesce(F.col(c) >= 9000, F.lit(False)) for c in WX])
    return rounded(audit.ratio_per_ship(t.f2_leg, lost), ["lost_pct"]).orderBy(F.col("lost_pct").desc(), "ship_id")


@query(
    "dir_min_max",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS low, max({c}) AS high FROM f2_leg" for c in DIRS),
)
def _(t):
    return audit.min_max(t.f2_leg, DIRS)


@query("value_counts", "SELECT ship_type, label, count(*) AS n_rows FROM f3_register GROUP BY ship_type, label")
def _(t):
    return audit.count_by(t.f3_register, ["ship_type", "label"])


def trim_sql(rules) -> str:
    """Each rule reads the survivors of the one before."""
    ctes, source = [], "f2_leg"
    for i, (col, low, high) in enumerate(rules):
        tests = [f"{col} >= quantile_cont({col}, {low}) OVER (PARTITION BY ship_id)"] if low is not None else []
        if high is not None:
            tests.append(f"{col} <= quantile_cont({col}, {high}) OVER (PARTITION BY ship_id)")
        ctes.append(f"t{i} AS (SELECT * FROM {source} QUALIFY {' AND '.join(tests)})")
        source = f"t{i}"
    return f"WITH {', '.join(ctes)} SELECT {ROWS}, og_speed, foc_me, rpm FROM {source}"


@query("quantile_trim", trim_sql(clean.TRIM_TAILS))
def _(t):
    return clean.quantile_trim(t.f2_leg, clean.TRIM_TAILS).select(*ROW, "og_speed", "foc_me", "rpm")


@query("quantile_trim_both_tails", trim_sql(clean.TRIM_BOTH))
def _(t):
    return clean.quantile_trim(t.f2_leg, clean.TRIM_BOTH).select(*ROW, "og_speed", "foc_me", "rpm")


@query(
    "global_quantile",
    f"""SELECT {r('quantile_cont(l_extendedprice, 0.03)')} AS q03, {r('quantile_cont(l_extendedprice, 0.97)')} AS q97
        FROM f2_leg""",
)
def _(t):
    return rounded(audit.quantile_row(t.f2_leg, "l_extendedprice", {"q03": 0.03, "q97": 0.97}), ["q03", "q97"])


@query(
    "point_class_counts",
    f"""WITH {gaps_sql('f1_leg_events')}, k AS (SELECT ship_id, {CLASS_SQL} AS c FROM g)
        SELECT ship_id, count(*) FILTER (WHERE c = 'isolated') AS n_isolated, count(*) FILTER (WHERE c = 'start') AS n_start,
          count(*) FILTER (WHERE c = 'end') AS n_end, count(*) FILTER (WHERE c = 'inner') AS n_inner, count(*) AS n_rows
        FROM k GROUP BY ship_id""",
)
def _(t):
    return runs.point_class_counts(runs.point_class(t.f1_leg_events), ["ship_id"])


@query(
    "point_class_shares",
    f"""WITH {gaps_sql('f1_leg_events')}, k AS (SELECT {CLASS_SQL} AS c FROM g)
        SELECT {r("count(*) FILTER (WHERE c = 'isolated') / count(*)")} AS isolated,
          {r("count(*) FILTER (WHERE c = 'start') / count(*)")} AS start_share,
          {r("count(*) FILTER (WHERE c = 'end') / count(*)")} AS end_share,
          {r("count(*) FILTER (WHERE c = 'inner') / count(*)")} AS inner_share FROM k""",
)
def _(t):
    n = runs.point_class_counts(runs.point_class(t.f1_leg_events))
    return n.select(
        rc(F.col("n_isolated") / F.col("n_rows")).alias("isolated"),
        rc(F.col("n_start") / F.col("n_rows")).alias("start_share"),
        rc(F.col("n_end") / F.col("n_rows")).alias("end_share"),
        rc(F.col("n_inner") / F.col("n_rows")).alias("inner_share"),
    )


@query(
    "run_length_stats",
    f"""WITH {runs_sql('f1_long')}, u AS (SELECT record_index, any_value(ship_id) AS ship_id, count(*) AS n FROM runs GROUP BY record_index)
        SELECT ship_id, count(*) AS n_runs, count(*) FILTER (WHERE n >= 64) AS n_long, min(n) AS min_len, max(n) AS max_len
        FROM u GROUP BY ship_id""",
)
def _(t):
    return runs.run_length_stats(runs.run_table(runs.continuous_runs(t.f1_long)))


@query(
    "loss_audit",
    f"""WITH {runs_sql('f1_long')}, f AS (SELECT *, foc_me < 0.15E0 * max(foc_me) OVER (PARTITION BY record_index) AS lost
          FROM runs WHERE record_length >= 56)
        SELECT {r('count(*) FILTER (WHERE lost) / count(*)')} AS row_share,
          {r('count(DISTINCT record_index) FILTER (WHERE lost) / count(DISTINCT record_index)')} AS run_share,
          {r('count(DISTINCT ship_id) FILTER (WHERE lost) / count(DISTINCT ship_id)')} AS ship_share FROM f""",
)
def _(t):
    flagged = runs.low_fuel_flag(stage(long_runs(t)))
    return rounded(audit.loss_audit(flagged, F.col("foc_too_small")), ["row_share", "run_share", "ship_share"])


@query(
    "stage_audit",
    f"""WITH s1 AS (SELECT *, row_number() OVER (PARTITION BY ship_id, client, utc ORDER BY l_orderkey, l_linenumber, l_partkey,
            l_extendedprice, foc_me, og_speed, rpm) AS rn FROM f2_leg),
          a AS (SELECT * FROM s1 WHERE rn = 1),
          b AS (SELECT * FROM a WHERE NOT ({any_sql('>= 9000')})),
          c AS (SELECT * FROM b WHERE sea_dir > 0 AND swl_dir > 0),
          d AS (SELECT c.* FROM c LEFT JOIN (SELECT {RATED} FROM f3_register) USING (ship_id) WHERE {RATED_SQL}),
          n AS (SELECT 0 AS step_no, '' AS step, count(*) AS n FROM f2_leg UNION ALL SELECT 1, 'dedup', count(*) FROM a
            UNION ALL SELECT 2, 'missing', count(*) FROM b UNION ALL SELECT 3, 'directions', count(*) FROM c
            UNION ALL SELECT 4, 'ratings', count(*) FROM d)
        SELECT x.step_no, x.step, y.n AS rows_in, x.n AS rows_out FROM n x JOIN n y ON y.step_no = x.step_no - 1""",
)
def _(t):
    legs = t.f2_leg
    once = clean.keep_first(legs, ["ship_id", "client", "utc"])
    rated_once = clean.join_ratings(once, t.f3_register, ["draft", "speed_at_mcr", "rpm_at_mcr"])
    return audit.stage_audit(
        [("loaded", legs), ("dedup", rated_once)],
        [("missing", clean.no_missing_ge(WX)), ("directions", clean.is_dir_positive()), ("ratings", clean.is_rated())],
    )


CORR = ["foc_me", "rpm", "og_speed", "draft_aft", "wind_v", "l_extendedprice"]


@query(
    "corr_per_ship",
    " UNION ALL ".join(
        f"SELECT ship_id, '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})')} AS corr FROM f2_leg GROUP BY ship_id"
        for a in CORR
        for b in CORR
        if a != b
    ),
)
def _(t):
    return rounded(audit.corr_matrix(t.f2_leg, CORR, ["ship_id"]), ["corr"])


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM f2_leg)
       SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 100.0E0)), 99) AS BIGINT) AS bin, count(*) AS n_rows
       FROM f2_leg, s GROUP BY bin""",
)
def _(t):
    return audit.histogram(t.f2_leg, "l_extendedprice")


@query(
    "histogram_group_size",
    """WITH n AS (SELECT count(*) AS n FROM f2_leg GROUP BY ship_id), s AS (SELECT min(n) AS lo, max(n) AS hi FROM n)
       SELECT CAST(least(floor((n - lo) / ((hi - lo) / 20.0E0)), 19) AS BIGINT) AS bin, count(*) AS n_rows FROM n, s GROUP BY bin""",
)
def _(t):
    return audit.histogram(audit.count_by(t.f2_leg, ["ship_id"]), "n_rows", 20)


@query(
    "class_sizes",
    """SELECT label, count(DISTINCT ship_id) AS n_ships, count(*) AS n_rows, count(DISTINCT record_index) AS n_runs
       FROM f5_prediction JOIN (SELECT ship_id, label FROM f3_register) USING (ship_id) GROUP BY label""",
)
def _(t):
    joined = t.f5_prediction.join(t.f3_register.select("ship_id", "label"), "ship_id")
    return joined.groupBy("label").agg(
        F.count_distinct("ship_id").alias("n_ships"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("record_index").alias("n_runs"),
    )


@query(
    "split_coverage",
    f"""SELECT type, count(DISTINCT record_index) AS n_runs,
          {r('count(DISTINCT record_index) / (SELECT count(DISTINCT record_index) FROM f5_prediction)')} AS share
        FROM f5_prediction GROUP BY type""",
)
def _(t):
    return rounded(evaluate.split_coverage(t.f5_prediction), ["share"])


@query(
    "test_rows_per_ship",
    f"""WITH {SPLIT_SQL} SELECT ship_id, count(*) AS n_test FROM split WHERE type = 'test' GROUP BY ship_id
        ORDER BY n_test DESC, ship_id DESC LIMIT 20""",
)
def _(t):
    tested = split_f2(t).where("type = 'test'")
    return audit.count_by(tested, ["ship_id"], "n_test").orderBy(F.col("n_test").desc(), F.col("ship_id").desc()).limit(20)


@query(
    "describe_min_max",
    " UNION ALL ".join(
        f"SELECT ship_id, '{c}' AS column_name, min({c}) AS low, max({c}) AS high FROM f2_leg GROUP BY ship_id"
        for c in ["foc_me", "og_speed", "rpm", "draft_aft"]
    ),
)
def _(t):
    return audit.min_max(t.f2_leg, ["foc_me", "og_speed", "rpm", "draft_aft"], ["ship_id"])


@query(
    "grouped_quantiles",
    f"""SELECT ship_id, {r('quantile_cont(l_extendedprice, 0.25)')} AS q25, {r('quantile_cont(l_extendedprice, 0.5)')} AS q50,
          {r('quantile_cont(l_extendedprice, 0.75)')} AS q75 FROM f2_leg GROUP BY ship_id""",
)
def _(t):
    q = grouped_quantiles(t.f2_leg, ["ship_id"], "l_extendedprice", [0.25, 0.5, 0.75])
    return q.select("ship_id", *[rc(F.col("quantiles")[i]).alias(n) for i, n in enumerate(["q25", "q50", "q75"])])


def _density_sql(cols: list[str], grid: int, where: str = "true") -> str:
    """Linear binning to the grid, then the kernel summed over it directly, all axes at once."""
    d = len(cols)
    axis = ", ".join(f"stddev_samp({c}) * pow(count(*), -1.0E0 / {d + 4}) AS h{i}, min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols))
    step = ", ".join(f"lo{i} - 3 * h{i} AS x{i}, (hi{i} - lo{i} + 6 * h{i}) / {grid - 1}.0E0 AS d{i}" for i in range(d))
    place = ", ".join(f"({c} - x{i}) / d{i} AS p{i}" for i, c in enumerate(cols))
    corner = ", ".join(f"CAST(floor(p{i}) AS BIGINT) + s{i} AS b{i}" for i in range(d))
    weight = " * ".join(f"(CASE WHEN s{i} = 1 THEN p{i} - floor(p{i}) ELSE 1 - p{i} + floor(p{i}) END)" for i in range(d))
    sides = ", ".join(f"range(2) r{i}(s{i})" for i in range(d))
    kernel = " * ".join(f"exp(-0.5E0 * ((g{i} - b{i}) * d{i} / h{i}) * ((g{i} - b{i}) * d{i} / h{i})) / (h{i} * sqrt(2 * pi()))" for i in range(d))
    points = ", ".join(f"range({grid}) q{i}(g{i})" for i in range(d))
    out = ", ".join(f"CAST(g{i} AS INTEGER) AS i_{c}, {r(f'any_value(x{i}) + g{i} * any_value(d{i})')} AS {c}" for i, c in enumerate(cols))
    return f"""WITH v AS (SELECT * FROM f2_leg WHERE {where}), m AS (SELECT client, count(*) AS n, {axis} FROM v GROUP BY client),
        a AS (SELECT *, {step} FROM m), p AS (SELECT client, {place} FROM v JOIN a USING (client)),
        c AS (SELECT client, {corner}, {weight} AS w FROM p, {sides}),
        b AS (SELECT client, {", ".join(f"b{i}" for i in range(d))}, sum(w) AS w FROM c GROUP BY ALL)
        SELECT client, {out}, {r(f'sum(w * {kernel}) / any_value(n)')} AS density
        FROM b JOIN a USING (client), {points} GROUP BY client, {", ".join(f"g{i}" for i in range(d))}"""


@query("kernel_density", _density_sql(["foc_me"], 100))
def _(t):
    """Density of fuel per client on 100 points."""
    table = density.densities(t.f2_leg, ["client"], ["foc_me"])
    return rounded(table, ["foc_me", "density"])


@query("kernel_density_2d", _density_sql(["og_speed", "foc_me"], 20))
def _(t):
    """Joint density of speed and fuel per client on 20 by 20 points."""
    table = density.densities(t.f2_leg, ["client"], ["og_speed", "foc_me"], grid=20)
    return rounded(table, ["og_speed", "foc_me", "density"])
