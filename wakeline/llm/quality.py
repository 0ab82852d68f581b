"""Quality rules from line frequencies across the documents of a host.

Normalised lines are hashed; a line that stands in too many documents of its host is removed from all of
them but the first, and a document that loses most of its characters so is rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.session import stage

from .common import BLANKS, NOT_BLANK, body, let, row_key, salt_of, salted, upto, without, words

MIN_DOCS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.5
SALTS = 32

SYMBOLS = "#*$%&|<>"


def _repeated(w: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more."""

    def spread(h: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda x, i, step: s[i + step]["h"] == x["h"]
            twice = F.filter(s, lambda x, i: ((i > 0) & same(x, i, -1)) | ((i + 1 < F.size(s)) & same(x, i, 1)))
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            # each window adds the words beyond the end of the one before it
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
                lambda a: a["n"],
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    windows = F.transform(upto(F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return let(windows, spread)


def _lines(text: Column) -> Column:
    """Position, hashes and length of each line with a word; case, digits and runs of blanks do not count."""
    flat = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    flat = F.translate(flat, "123456789", "0" * 9)
    line = F.transform(F.split(flat, "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("x")))
    return F.transform(
        F.filter(line, lambda s: s["x"] != ""),
        lambda s: F.struct(
            s["pos"].alias("pos"),
            F.xxhash64(s["x"]).alias("h"),
            F.hash(s["x"]).alias("g"),
            F.char_length(s["x"]).alias("chars"),
        ),
    )


def profile(docs: DataFrame, host: str = "source") -> DataFrame:
    """One stage row per document: key, host, counts and hashed lines; the text is read once."""
    text = body()
    dup = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK)), lambda x: F.size(x) - F.size(F.array_distinct(x))
    )
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    rows = docs.select(
        row_key().alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
        counts.alias("c"),
        F.char_length(F.translate(text, " " + BLANKS, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        dup.alias("n_dup_lines"),
        _lines(text).alias("lines"),
    )
    return stage(rows, "quality")


def frequent_lines(profiles: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Lines in more than ``min_docs`` documents and more than ``max_share`` of the documents of their host."""
    lines = profiles.select("host", "key", F.explode("lines").alias("l"))
    seen = lines.select("host", "l.h", "l.g", "key").distinct()
    per_line = seen.groupBy("host", "h", "g").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    hosts = profiles.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    many = per_line.where(F.col("n") > min_docs).join(hosts, "host")
    return many.where(F.col("n") > max_share * F.col("n_docs")).select("host", "h", "g", "n", "first")


def line_quality(
    docs: DataFrame,
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """key, counts, removed (positions of frequent lines), removed_chars, base_failed, kept; one row per document row.

    A null text is empty, a null host is a host of its own. The first document with a frequent line (smallest
    id, null first, then text hash) keeps it, so no text is lost from all of its copies. Rows with one id and
    one text count as one document. An empty table gives an empty result; other columns are not read.
    """
    rows = profile(docs, host)
    frequent = salted(frequent_lines(rows, min_docs, max_share), SALTS)
    lines = rows.select("host", "key", salt_of(F.col("key"), SALTS).alias("salt"), F.explode("lines").alias("l"))
    lines = lines.select("host", "key", "salt", "l.*")
    hit = lines.join(frequent, ["host", "h", "g", "salt"]).where(F.col("key") != F.col("first"))
    lost = hit.groupBy("key").agg(F.collect_set(F.struct("pos", "chars")).alias("hit"))
    out = rows.join(lost, "key", "left")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    gone = F.coalesce(F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["chars"]), F.lit(0))
    out = out.select(
        "key",
        F.col("c.n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("c.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.transform("hit", lambda x: x["pos"]).alias("removed"),
        gone.alias("removed_chars"),
        total.alias("line_chars"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("line_chars") - F.col("removed_chars") < min_left * F.col("line_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def apply_quality(docs: DataFrame, report: DataFrame) -> DataFrame:
    """The kept documents, frequent lines taken out of their texts; all columns of ``docs`` in their order."""
    verdicts = report.where("kept").groupBy("key").agg(F.first("removed").alias("removed"))
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key")).join(verdicts, "key")
    left = F.array_join(without(F.split("row.text", "\n"), F.col("removed")), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left)
    rows = rows.select("row", text.alias("new"))
    fresh = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return rows.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
