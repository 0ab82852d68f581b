"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

A seed is a fixed mask over a span of words: the words under its ones are hashed, the others may differ.
Seeds of the texts meet seeds of the benchmark items by hash; each diagonal (text position less item
position) that has a hit is verified word by word, mismatches counted against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.session import stage

from .common import body, let, lower_az, row_key, salt_of, salted, upto, words

# One fixed mask of weight 6 over 10 words. At every position it meets more overlaps than two masks of weight 8 do, and
# costs less; tests/llm measures what it finds against verifying every diagonal.
MASKS = ("1101100101",)
PENALTY = 2
MIN_SCORE = 10
MIN_SPAN = 12
BROADCAST_SEEDS = 1_000_000  # rows of two hashes and four numbers: at most about 80 MB; beyond it the join shuffles
SALTS = 32


def tokens(text: Column) -> Column:
    """Lower-case words without the punctuation around them; words of punctuation alone are dropped."""
    return words(lower_az(F.translate(text, ".,;:!?\"'()[]{}«»¿¡…*_", " " * 22)))


def _seeds(w: Column, masks: tuple[str, ...]) -> Column:
    """Hashes of all masks at every position, mask after mask; the masks have one span."""
    starts = upto(F.size(w) - (len(masks[0]) - 1))
    at = lambda number, on: lambda i: F.xxhash64(F.lit(number), *[w[i + j] for j in on])
    ones = [[j for j, bit in enumerate(mask) if bit == "1"] for mask in masks]
    rows = [F.transform(starts, at(number, on)) for number, on in enumerate(ones)]
    return F.concat(*rows)


def _seeded(frame: DataFrame, text: Column, masks: tuple[str, ...], *cols: Column) -> DataFrame:
    """``cols``, h and pos: one row for each mask and position."""
    seeds = frame.select(*cols, let(tokens(text), lambda w: _seeds(w, masks)).alias("s"))
    per_mask = F.size("s") / len(masks)
    rows = seeds.select(*[c for c in seeds.columns if c != "s"], per_mask.cast("int").alias("m"), F.posexplode("s").alias("i", "h"))
    return rows.withColumn("pos", F.expr("cast(i % m as int)")).drop("i", "m")


def verified(doc: Column, item: Column) -> Column:
    """The best stretch of two aligned word arrays: score, first and end position, equal words in it.

    An equal word counts one, a different one ``-PENALTY``; the best-scoring stretch of all is taken, the
    earliest of equal ones.
    """
    same = F.zip_with(doc, item, lambda x, y: F.coalesce(x == y, F.lit(False)))
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("equal"),
        F.lit(0).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(0).alias("n_equal"),
    )

    def add(a: Column, hit: Column) -> Column:
        fresh = a["score"] <= 0
        score = F.when(fresh, 0).otherwise(a["score"]) + F.when(hit, 1).otherwise(-PENALTY)
        start = F.when(fresh, a["at"]).otherwise(a["start"])
        equal = F.when(fresh, 0).otherwise(a["equal"]) + F.when(hit, 1).otherwise(0)
        better = score > a["best"]
        return F.struct(
            (a["at"] + 1).alias("at"), score.alias("score"), start.alias("start"), equal.alias("equal"),
            F.when(better, score).otherwise(a["best"]).alias("best"),
            F.when(better, start).otherwise(a["first"]).alias("first"),
            F.when(better, a["at"] + 1).otherwise(a["end"]).alias("end"),
            F.when(better, equal).otherwise(a["n_equal"]).alias("n_equal"),
        )

    return F.aggregate(same, zero, add)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS, masks: tuple[str, ...] = MASKS
) -> DataFrame:
    """key, item_id, first_word, end_word, n_equal, score: the best verified overlap of a text with a benchmark item.

    Seeds cover every position of items and texts, so an overlap with ten equal words in a row is always hit. Verified
    stretches have at least ``MIN_SPAN`` words and score at least ``MIN_SCORE``; of equal scores the first in the text
    is told. Null and short texts have no seed; items of fewer than ``MIN_SPAN`` words are never hit. Rows with one id and one text are
    one document. Repeated item rows count once; an empty table on either side gives an empty result.
    """
    items = benchmark.select("item_id", body().alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("text").alias("ih"), tokens(F.col("text")).alias("item"), "text")
    items = stage(items.withColumn("n_item", F.size("item")), "items")
    bench = _seeded(items, F.col("text"), masks, F.col("item_id"), F.col("ih"), F.col("n_item"))
    bench = stage(bench.withColumnRenamed("pos", "ipos").distinct(), "seeds")
    texts = _seeded(docs, body(), masks, row_key().alias("key"))
    if bench.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        hits = texts.join(F.broadcast(bench), "h")
    else:
        texts = texts.withColumn("salt", salt_of(F.struct("key", "pos"), SALTS))
        hits = texts.join(salted(bench, SALTS), ["h", "salt"])
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("ipos"))
    lines = hits.groupBy("key", "item_id", "ih", "n_item", "diagonal").agg(F.count("*").alias("n_hits"))
    # one document has at most as many diagonals as it has hits
    lines = stage(lines, "diagonals")
    per_doc = lines.groupBy("key").agg(F.collect_list(F.struct("item_id", "ih", "n_item", "diagonal")).alias("hits"))
    rows = docs.select(row_key().alias("key"), body().alias("text")).join(per_doc, "key")
    start = lambda x: F.greatest(x["diagonal"], F.lit(0))
    rows = rows.select(
        "key",
        F.explode(
            let(
                tokens(F.col("text")),
                lambda w: F.transform(
                    "hits",
                    lambda x: F.struct(
                        x["item_id"].alias("item_id"),
                        x["ih"].alias("ih"),
                        start(x).alias("from"),
                        (start(x) - x["diagonal"]).alias("skip"),
                        F.slice(w, start(x) + 1, x["n_item"] - (start(x) - x["diagonal"])).alias("doc"),
                    ),
                ),
            )
        ).alias("x"),
    ).select("key", "x.*")
    texts_of = items.select(F.struct("item_id", "ih").alias("ik"), "item")
    pairs = rows.withColumn("ik", F.struct("item_id", "ih")).join(texts_of, "ik")
    part = F.slice("item", F.col("skip") + 1, F.size("doc"))
    found = pairs.select("key", "item_id", "from", verified(F.col("doc"), part).alias("v"))
    found = found.where((F.col("v.best") >= MIN_SCORE) & (F.col("v.end") - F.col("v.first") >= MIN_SPAN))
    spans = found.select(
        "key",
        "item_id",
        F.struct(
            F.col("v.best").alias("score"),
            (-(F.col("from") + F.col("v.first"))).alias("back"),
            (F.col("from") + F.col("v.end")).alias("end_word"),
            F.col("v.n_equal").alias("n_equal"),
        ).alias("s"),
    )
    best = spans.groupBy("key", "item_id").agg(F.max("s").alias("s"))
    return best.select(
        "key",
        "item_id",
        (-F.col("s.back")).cast("long").alias("first_word"),
        F.col("s.end_word").cast("long").alias("end_word"),
        F.col("s.n_equal").cast("long").alias("n_equal"),
        F.col("s.score").cast("long").alias("score"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that share a verified stretch with a benchmark item."""
    bad = contaminated(docs, benchmark).select("key").distinct()
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key")).join(bad, "key", "left_anti")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
