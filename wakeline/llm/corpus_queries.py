"""Queries over ``documents`` whose operators are also stages of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, linededup, mixing, quality, simhash
from .registry import query, table

MAX_PASSES = 2.0

_OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, host,
  list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws
  FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g3, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, host, pos,
  trim(translate(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '123456789', '000000000'), ' ') AS x FROM l),
line AS (SELECT * FROM norm WHERE x <> ''),
hosts AS (SELECT host, count(*) AS n_docs FROM d GROUP BY host),
often AS (SELECT host, x, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM line GROUP BY host, x),
frequent AS (SELECT host, x, first FROM often JOIN hosts USING (host) WHERE n > {quality.MIN_DOCS} AND n > {quality.MAX_SHARE} * n_docs),
gone AS (SELECT doc_id, sum(length(x)) AS chars, sum(CASE WHEN first IS NOT NULL AND first <> doc_id THEN length(x) ELSE 0 END) AS lost,
  sum(CASE WHEN first IS NOT NULL AND first <> doc_id THEN 1 ELSE 0 END) AS n
  FROM line LEFT JOIN frequent USING (host, x) GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws) AS n_words,
  length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(gone.n, 0) AS n_removed_lines, coalesce(chars, 0) AS chars, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND chars - lost >= {quality.MIN_LEFT} * chars AS kept, CAST(n_removed_lines AS BIGINT) AS n_removed_lines
FROM f
"""


@query("op1_quality_rules", _OP1)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.line_quality(table(spark, sf_dir, "documents"))
    return report.select(
        F.col("key.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed_lines"),
    )


_OP8 = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS pos FROM d),
f AS (SELECT doc_id, x, pos, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(pos, 1) OVER o AS p2, lead(pos, 2) OVER o AS p3
  FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT *, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id, pos) AS rn FROM f WHERE p3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([pos, p2, p3]) AS pos FROM w WHERE rn > 1),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY pos) AS kept FROM l ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN n.n IS NULL THEN text ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op8_line_dedup", _OP8)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key.doc_id").alias("doc_id"), "item_id", "first_word", "end_word", "n_equal", "score")


@query("op6_temperature_mixing")
def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_passes=MAX_PASSES)
    return drawn.select("doc_id", "source", "epoch", "position")
