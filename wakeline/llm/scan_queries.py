"""Queries that scan texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixity, licenses, rendering, secrets, suffixes
from .registry import query, table


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("key.doc_id")).drop("key")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.secret_scan(docs, secrets.fit(docs))
    base = F.filter("spans", lambda s: s["kind"] != "net")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extract(table(spark, sf_dir, "pages"))


_OP5 = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT CAST(floor(page_id / {fixity.ARCHIVE}) AS BIGINT) AS archive, page_id,
  strlen('WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:') + 64 - 6 + strlen('>\r\nWARC-Target-URI: ') - 2
  + strlen(url) + strlen('\r\nContent-Type: text/html\r\nContent-Length: ') - 4 + strlen(CAST(strlen(html) AS VARCHAR)) + 4
  + strlen(html) + 4 + 2 AS length FROM p),
o AS (SELECT archive, row_number() OVER w - 1 AS seq, length,
  coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs
  FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id))
SELECT archive, seq, 'changed' AS finding, CAST(offs AS BIGINT) AS at_byte, CAST(length AS BIGINT) AS n_bytes,
  CAST(offs AS BIGINT) AS replica_at_byte, CAST(length AS BIGINT) AS replica_n_bytes
FROM o WHERE md5(archive || ':' || seq)[1:2] < '03'
"""


@query("op5_merkle_fixity", _OP5)
def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixity.warc_records(table(spark, sf_dir, "pages"))
    replica = fixity.damaged(records)
    return fixity.audit(fixity.record_hashes(records), fixity.record_hashes(replica))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
