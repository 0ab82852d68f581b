"""Merkle fixity audit of WARC archives and their replicas.

Every archive is a run of WARC records in the order of their offsets. Record hashes are the leaves of a
tree over ordered offset ranges; replicas are compared root by root, and only the children of nodes that
differ are looked at, level by level, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.session import stage

ARCHIVE = 1000  # records in an archive
FAN = 16


def warc_records(pages: DataFrame, per_archive: int = ARCHIVE) -> DataFrame:
    """archive, seq, page_id, offset, length and record (WARC/1.1 resource records, UTF-8 text) of every page.

    Pages with the ids k * per_archive to (k + 1) * per_archive - 1 make archive k, in the order of id, url
    and content; pages without an id are dealt to archives below zero by a hash of url and content, so that
    none grows with the table. Null urls and contents are empty. offset and length count bytes.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"),
        F.sha2(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"), url, F.lit("\n"), html), 256),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    lost = -1 - F.pmod(F.xxhash64(url, html), F.lit(1 << 40))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_archive), lost).cast("long").alias("archive"),
        "page_id",
        F.concat(head, html, F.lit("\r\n\r\n")).alias("record"),
    ).withColumn("length", F.octet_length("record").cast("long"))
    # an archive is bounded by per_archive, so its window is too
    order = Window.partitionBy("archive").orderBy("page_id", F.sha2("record", 256))
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "page_id",
        F.coalesce(before, F.lit(0)).cast("long").alias("offset"),
        "length",
        "record",
    )


def record_hashes(records: DataFrame) -> DataFrame:
    """archive, seq, offset, length and hash (SHA-256 of offset and record bytes), as a stage table."""
    mark = F.concat(F.col("offset").cast("string"), F.lit(":"), F.col("record"))
    return stage(records.select("archive", "seq", "offset", "length", F.sha2(mark, 256).alias("hash")), "hashes")


def merkle(hashes: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """archive, level, node, from_offset, to_offset and hash of every node; level 0 holds the records.

    A node hashes the hashes of its children in the order of their offsets, with their places.
    """
    now = hashes.select(
        "archive",
        F.lit(0).alias("level"),
        F.col("seq").alias("node"),
        F.col("offset").alias("from_offset"),
        (F.col("offset") + F.col("length")).alias("to_offset"),
        "hash",
    )
    out = now
    for level in range(1, levels + 1):
        child = F.struct("node", "hash", "from_offset", "to_offset")
        now = now.groupBy("archive", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(
            F.sort_array(F.collect_list(child)).alias("c"),  # at most ``fan`` children, copies of a record aside
            F.min("from_offset").alias("from_offset"),
            F.max("to_offset").alias("to_offset"),
        )
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"], x["hash"])), ",")
        now = now.select("archive", F.lit(level).alias("level"), "node", "from_offset", "to_offset", F.sha2(joined, 256).alias("hash"))
        now = stage(now, "merkle")
        out = out.unionByName(now)
    return out


def _levels(*hashes: DataFrame, fan: int) -> int:
    """Levels above the records until every archive has one root."""
    last = max((h.agg(F.max("seq")).first()[0] or 0) for h in hashes)
    levels = 1
    while fan**levels <= last:
        levels += 1
    return levels


def audit(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """archive, seq, finding, and offset and length on both sides, of every record that differs.

    ``left`` and ``right``: archive, seq, offset, length, hash of the two replicas. finding: changed (other
    bytes or place), missing (not in ``right``) or added (not in ``left``). Subtrees with equal hashes are not
    entered. An archive on one side only is reported record by record; empty tables differ in nothing.
    """
    levels = _levels(left, right, fan=fan)
    trees = [merkle(side, levels, fan) for side in (left, right)]
    parents = None
    for level in range(levels, -1, -1):
        sides = [t.where(F.col("level") == level) for t in trees]
        if parents is not None:
            keep = parents.select("archive", F.col("node").alias("parent"))
            up = F.floor(F.col("node") / fan).cast("long")
            sides = [s.withColumn("parent", up).join(keep, ["archive", "parent"], "left_semi").drop("parent") for s in sides]
        a, b = (_renamed(s, mark) for s, mark in zip(sides, "ab"))
        both = a.join(b, ["archive", "node"], "full")
        parents = both.where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
        parents = stage(parents, "differ")
        if level and parents.isEmpty():
            break
    finding = F.when(F.col("a_hash").isNull(), "added").when(F.col("b_hash").isNull(), "missing").otherwise("changed")
    return parents.select(
        "archive",
        F.col("node").alias("seq"),
        finding.alias("finding"),
        F.col("a_from").alias("at_byte"),
        (F.col("a_to") - F.col("a_from")).alias("n_bytes"),
        F.col("b_from").alias("replica_at_byte"),
        (F.col("b_to") - F.col("b_from")).alias("replica_n_bytes"),
    )


def _renamed(side: DataFrame, mark: str) -> DataFrame:
    return side.select(
        "archive",
        "node",
        F.col("hash").alias(f"{mark}_hash"),
        F.col("from_offset").alias(f"{mark}_from"),
        F.col("to_offset").alias(f"{mark}_to"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one folder an archive: each record ends with the two line ends that part it from the next."""
    rows = records.repartition("archive").sortWithinPartitions("archive", "seq")
    body = F.expr("left(record, char_length(record) - 4)").alias("value")
    rows.select("archive", body).write.partitionBy("archive").option("lineSep", "\r\n\r\n").text(path)


def damaged(records: DataFrame, below: str = "03") -> DataFrame:
    """A replica with one character changed in the records whose MD5 of archive and place begins below ``below``.

    Places are kept; the default hits three records in 256.
    """
    hit = F.substring(F.md5(F.concat_ws(":", "archive", "seq")), 1, 2) < below
    at = (F.char_length("record") / 2).cast("int")
    other: Column = F.when(F.substring("record", at, 1) == "x", "y").otherwise("x")
    changed = F.concat(F.expr("left(record, char_length(record) div 2 - 1)"), other, F.expr("substr(record, char_length(record) div 2 + 1)"))
    return records.withColumn("record", F.when(hit, changed).otherwise(F.col("record")))
