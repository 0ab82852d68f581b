"""Queries of the filter audit, the packing and the run detection."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import interactions, packing, periodic
from .registry import query, table


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the checksum of its id, ends in a loop over its own words (fixed rule of the query)."""
    n = len(words)
    if not n or doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '),
  lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN translate(t, '#$%&*|', '') <> t THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k, substr(o, k, 1) AS here, substr(o, 1, k - 1) AS before FROM o, range(1, 6) r(k)),
g AS (SELECT part, o, k, here, n, good, toxic, fails, contains(fails, here) AS f, translate(fails, before, '') = fails AS there FROM c, s),
r AS (SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, here,
  sum(CASE WHEN there AND NOT f THEN n ELSE 0 END) AS kept, sum(CASE WHEN there AND f THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN NOT there AND f THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = here THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN there AND f THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN there AND f THEN toxic ELSE 0 END) AS toxic_lost
  FROM g GROUP BY part, o, k, here)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM r
"""


@query("op11_filter_interactions", _OP11)
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = interactions.filter_masks(table(spark, sf_dir, "documents"))
    return interactions.interactions(masks, table(spark, sf_dir, "labels"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), alter=looped)
    # greatest length, then smallest start, then smallest period
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("m", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("m.s")).alias("start"),
        F.col("m.l").alias("length"),
        (-F.col("m.p")).alias("period"),
        F.expr("1000 * m.l div -m.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query("op12_cost_packing")
def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    crc = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
