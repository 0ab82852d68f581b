"""Registry of named queries and the fixture views they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The same text runs in both engines; each view stands in for one entity of the data model.
VIEWS: dict[str, str] = {
    "f1_leg_events": """
        SELECT event_id, user_id AS ship_id, event_type AS client, ts AS utc, value AS foc_me FROM events""",
    "f2_leg": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
          l_suppkey AS ship_id, l_returnflag AS client, l_shipdate + l_linenumber * INTERVAL '1' HOUR AS utc,
          l_quantity AS foc_me, 8 + l_discount * 100 AS og_speed, 60 + l_tax * 500 AS rpm,
          CAST((l_partkey * 37 + l_linenumber * 11) % 360 AS DOUBLE) AS course,
          CASE WHEN l_orderkey % 19 = 0 THEN 9000.0E0 ELSE l_discount - 0.05E0 END AS crnt_u,
          l_tax - 0.04E0 AS crnt_v,
          CASE WHEN l_orderkey % 17 = 0 THEN 9999.0E0 ELSE CAST(l_partkey % 41 - 20 AS DOUBLE) END AS wind_u,
          CAST(l_orderkey % 37 - 18 AS DOUBLE) AS wind_v,
          CAST((l_orderkey * 13) % 400 - 20 AS DOUBLE) AS sea_dir, l_discount * 60 AS sea_ht,
          4 + l_tax * 100 AS sea_per, l_discount * 40 + l_tax * 10 AS sig_ht,
          CAST((l_partkey * 17) % 380 - 10 AS DOUBLE) AS swl_dir, l_tax * 50 AS swl_ht, 6 + l_discount * 50 AS swl_per,
          CAST((l_partkey * 23) % 370 - 5 AS DOUBLE) AS pri_dir, l_discount * 50 AS pri_ht, 5 + l_tax * 80 AS pri_per,
          CAST((l_orderkey * 29) % 390 - 15 AS DOUBLE) AS sec_dir, l_tax * 30 AS sec_ht, 3 + l_discount * 40 AS sec_per,
          CAST(l_partkey % 120 - 60 AS DOUBLE) AS lat, CAST(l_orderkey % 360 - 180 AS DOUBLE) AS lon,
          CAST(8 + l_linenumber AS DOUBLE) AS draft_aft, CAST(7 + l_linenumber AS DOUBLE) AS draft_fore
        FROM lineitem""",
    "f3_register": """
        SELECT s_suppkey AS ship_id,
          CASE WHEN s_suppkey % 2 = 0 THEN 'BULK CARRIER' ELSE 'CONTAINER SHIP' END AS ship_type,
          CAST(100 + s_suppkey % 200 AS DOUBLE) AS length, CAST(20 + s_suppkey % 30 AS DOUBLE) AS breadth,
          CASE WHEN s_suppkey % 29 = 0 THEN 0.0E0 ELSE CAST(10 + s_suppkey % 12 AS DOUBLE) END AS depth,
          CAST(8 + s_suppkey % 4 AS DOUBLE) AS draft, CAST(20000 + (s_suppkey * 977) % 150000 AS DOUBLE) AS dwt,
          CAST(15000 + (s_suppkey * 613) % 80000 AS DOUBLE) AS gt,
          CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE CAST(8000 + (s_suppkey * 389) % 30000 AS DOUBLE) END AS power_at_mcr,
          CAST(14 + s_suppkey % 6 AS DOUBLE) AS speed_at_mcr, CAST(85 + s_suppkey % 30 AS DOUBLE) AS rpm_at_mcr,
          CAST(1985 + s_suppkey % 35 AS DOUBLE) AS date_built_year, CAST(s_suppkey % 5 AS INT) AS label FROM supplier""",
    "f4_voyage": """
        SELECT o_orderkey % (SELECT count(*) FROM supplier) AS ship_id, o_orderdate AS dep_utc,
          o_orderdate + (1 + o_orderkey % 10) * INTERVAL '24' HOUR AS arr_utc FROM orders""",
    "f5_prediction": """
        SELECT l_suppkey AS ship_id, l_orderkey AS record_index, l_shipdate AS utc,
          CASE WHEN l_orderkey % 5 = 4 THEN 'test' WHEN l_orderkey % 5 = 3 THEN 'val' ELSE 'train' END AS type,
          l_quantity AS tw_speed, l_quantity + (l_discount - 0.05E0) * 20 AS pred_tw_speed FROM lineitem""",
    "f6_leg_text": """
        SELECT l_orderkey, l_linenumber, l_suppkey AS ship_id,
          CASE WHEN l_orderkey % 11 = 0 THEN '--' WHEN l_orderkey % 13 = 0 THEN ''
               WHEN l_orderkey % 31 = 0 THEN NULL ELSE CAST(l_quantity AS STRING) END AS rpm
        FROM lineitem""",
    # one ship of many events, one ship of few: long runs, as in the 56-row rule
    "f1_long": """
        SELECT user_id % 10 AS ship_id, CAST(floor(user_id / 10.0E0) AS BIGINT) % 2 AS client,
          ts AS utc, event_id, value AS foc_me
        FROM events""",
}

_BASE = {
    "f1_leg_events": ["events"],
    "f2_leg": ["lineitem"],
    "f3_register": ["supplier"],
    "f4_voyage": ["orders", "supplier"],
    "f5_prediction": ["lineitem"],
    "f6_leg_text": ["lineitem"],
    "f1_long": ["events"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a lazy DataFrame."""
    text = VIEWS[name]
    args = {}
    for base in _BASE[name]:
        text = re.sub(rf"\bFROM {base}\b", f"FROM {{{base}}}", text)
        args[base] = table(spark, sf_dir, base)
    return spark.sql(text, **args)


def oracle(sql: str) -> str:
    """Prefix the SQL with the fixture views it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    body = sql.strip().rstrip(";")
    if not used:
        return body
    heads = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in used)
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def query(key: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart on the same tables."""

    def add(fn: Callable[..., DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Reader(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return fn

    return add


class Reader:
    """Tables and fixture views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def r(expr: str, digits: int = 6) -> str:
    """SQL text of the rounding that both engines compute with the same operations."""
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def rc(col: str | Column, digits: int = 6) -> Column:
    """The same rounding as a column."""
    c = F.col(col) if isinstance(col, str) else col
    scale = F.lit(float(10**digits))
    return F.floor(c.cast("double") * scale + F.lit(0.5)) / scale


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[rc(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])
