"""Line dedup over overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.session import stage

from .common import NOT_BLANK, body, let, row_key, salt_of, salted, upto, without

SALTS = 32


def _windows(text: Column) -> Column:
    """Hashes of each three consecutive lines with a word, and the positions of the three lines."""

    def over(lines: Column) -> Column:
        full = F.filter(upto(F.size(lines)), lambda i: lines[i].rlike(NOT_BLANK))

        def each(at: Column) -> Column:
            three = lambda j: (lines[at[j]], lines[at[j + 1]], lines[at[j + 2]])
            return F.transform(
                upto(F.size(at) - 2),
                lambda j: F.struct(
                    F.xxhash64(*three(j)).alias("h"),
                    F.hash(*three(j)).alias("g"),
                    F.array(at[j], at[j + 1], at[j + 2]).alias("at"),
                ),
            )

        return let(full, each)

    return let(F.split(text, "\n"), over)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """key, removed: positions of the lines that a later occurrence of a window covers, for documents that have any."""
    windows = stage(docs.select(row_key().alias("key"), F.explode(_windows(body())).alias("w")), "windows")
    windows = windows.select("key", "w.*")
    place = F.struct("key", F.col("at")[0].alias("pos"))
    # every occurrence of a window collapses to its first place before the shuffle
    firsts = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    later = windows.withColumn("place", place).withColumn("salt", salt_of(F.col("place"), SALTS))
    later = later.join(salted(firsts, SALTS), ["h", "g", "salt"]).where(F.col("place") != F.col("first"))
    # windows overlap: their positions merge into one set a document
    return later.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows removed, plus n_lines and n_removed.

    Windows run over the lines with a word; blank lines stay where they are. Order is by doc_id (null first),
    then text hash, then position; the first occurrence keeps its lines unless a later window, which may
    overlap it, covers them. Rows with one id and one text are one document. A null text stays null with no
    lines removed, a text of fewer than three lines has no window, an empty table gives an empty result.
    Columns named n_lines or n_removed are replaced; n_chars follows the text where it is present.
    """
    gone = repeated_lines(docs)
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key")).join(gone, "key", "left")
    text = F.array_join(without(F.split("row.text", "\n"), F.col("removed")), "\n")
    rows = rows.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(text).alias("new"),
        F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).cast("long").alias("lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("gone"),
    )
    fresh = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(
        *[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept],
        F.col("lines").alias("n_lines"),
        F.col("gone").alias("n_removed"),
    )
