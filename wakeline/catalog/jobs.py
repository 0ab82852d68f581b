"""The cleaning job from telemetry to continuous records, as one entry and as the audit of its steps."""

from __future__ import annotations

from ..operators import clean
from ..plans import pipeline
from ..schema import MEASURED
from .analytics import knn_sql
from .filters import RATED_SQL, any_sql
from .physics import CRNT_L, KW
from .registry import query, rounded

COLS = ["ship_id", "client", "utc", *MEASURED]
LIST = ", ".join(COLS)
# the canonical rules scaled to the fixture, whose ships have fewer and sparser rows
RULES = pipeline.CleaningRules(
    min_rows=150, gap_hours=24 * 25, min_run=5, low_fuel=0.04, change_band=(1.0, 1500.0), bucket_hours=24 * 30
)
GAP_US = int(RULES.gap_hours * 3_600_000_000)


def _history(name: str, source: str) -> str:
    return f"""{name} AS (SELECT {LIST} FROM {source} WHERE ship_id IN
        (SELECT ship_id FROM {source} GROUP BY ship_id HAVING count(*) >= {RULES.min_rows}))"""


POINTS = f"""SELECT {", ".join("h." + c for c in COLS)}, (rpm / rpm_at_mcr) * (rpm / rpm_at_mcr) * (rpm / rpm_at_mcr) AS x,
    foc_me / {KW} AS y, (og_speed - {CRNT_L}) / speed_at_mcr AS z FROM h JOIN k USING (ship_id)"""
JOB = f"""k AS (SELECT * FROM f3_register WHERE power_at_mcr IS NOT NULL AND depth > 0),
    known AS (SELECT {LIST} FROM f2_leg WHERE ship_id IN (SELECT ship_id FROM k)),
    once AS (SELECT {LIST} FROM (SELECT *, row_number() OVER (PARTITION BY ship_id, client, utc ORDER BY {", ".join(MEASURED)}) AS rn FROM known)
      WHERE rn = 1),
    whole AS (SELECT * FROM once WHERE NOT ({any_sql('>= 9000')})),
    ahead AS (SELECT * FROM whole WHERE sea_dir > 0 AND swl_dir > 0),
    rated AS (SELECT {LIST} FROM ahead JOIN (SELECT ship_id, draft, speed_at_mcr, rpm_at_mcr FROM k) USING (ship_id) WHERE {RATED_SQL}),
    {_history("h", "rated")},
    {knn_sql(POINTS, ["x", "y", "z"])},
    q AS (SELECT *, quantile_cont(score, {1 - RULES.contamination}) OVER (PARTITION BY ship_id) AS cut FROM s),
    normal AS (SELECT {LIST} FROM q WHERE NOT coalesce(score > cut, FALSE)),
    {_history("kept", "normal")},
    gaps AS (SELECT *, epoch_us(utc) - epoch_us(lag(utc) OVER w) AS g1, epoch_us(lead(utc) OVER w) - epoch_us(utc) AS g2 FROM kept
      WINDOW w AS (PARTITION BY ship_id, client ORDER BY utc)),
    met AS (SELECT {LIST}, CAST(sum(CASE WHEN coalesce(g1, {2**60}) > {GAP_US} THEN 1 ELSE 0 END) OVER (ORDER BY ship_id, client, utc
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS record_index FROM gaps WHERE NOT (coalesce(g1, {2**60}) > {GAP_US} AND coalesce(g2, {2**60}) > {GAP_US})),
    runs AS (SELECT *, count(*) OVER (PARTITION BY record_index) AS record_length FROM met),
    long AS (SELECT * FROM runs WHERE record_length >= {RULES.min_run}),
    burning AS (SELECT * FROM long WHERE record_index NOT IN
      (SELECT record_index FROM long GROUP BY record_index HAVING min(foc_me) < {RULES.low_fuel} * max(foc_me))),
    steps AS (SELECT record_index, coalesce(abs((foc_me - lead(foc_me) OVER w) / nullif(foc_me, 0) * 100), 0) AS step FROM burning
      WINDOW w AS (PARTITION BY record_index ORDER BY utc)),
    banded AS (SELECT * FROM burning WHERE record_index IN (SELECT record_index FROM steps GROUP BY record_index
      HAVING max(step) BETWEEN {RULES.change_band[0]} AND {RULES.change_band[1]}))"""
# step names of the job and the tables that hold what they leave
STEPS = {
    "known_ships": "known", "dedup": "once", "missing": "whole", "directions": "ahead", "ratings": "rated", "history": "h",
    "outliers": "normal", "history_again": "kept", "connected": "runs", "run_length": "long", "low_fuel": "burning",
    "change_band": "banded",
}


@query(
    "telemetry_records",
    f"WITH {JOB} SELECT ship_id, client, utc, foc_me, rpm, og_speed, record_index, record_length FROM banded",
)
def _(t):
    """Rows of usable continuous runs, straight from telemetry and register."""
    records = pipeline.telemetry_to_records(t.f2_leg.select(*COLS), clean.register_clean(t.f3_register), RULES)
    return records.select("ship_id", "client", "utc", "foc_me", "rpm", "og_speed", "record_index", "record_length")


def _audit_sql() -> str:
    parts = ["SELECT 0 AS step_no, 'loaded' AS step, count(*) AS n, count(DISTINCT ship_id) AS ships FROM f2_leg"]
    parts += [f"SELECT {i}, '{step}', count(*), count(DISTINCT ship_id) FROM {name}" for i, (step, name) in enumerate(STEPS.items(), 1)]
    return f"""WITH {JOB}, n AS ({" UNION ALL ".join(parts)})
        SELECT x.step_no, x.step, y.n AS rows_in, x.n AS rows_out, y.ships AS ships_in, x.ships AS ships_out
        FROM n x JOIN n y ON y.step_no = x.step_no - 1"""


@query("job_audit", _audit_sql())
def _(t):
    """Rows and ships before and after every step of the job."""
    return pipeline.job_audit(t.f2_leg.select(*COLS), clean.register_clean(t.f3_register), RULES)
