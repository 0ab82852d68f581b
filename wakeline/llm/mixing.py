"""Mixing sources to target weights: tempered shares, realised as block permutations. DataFrame functions only.

Source token shares are raised to an exponent; bisection finds the exponent that meets a repetition limit
or a target entropy. The weights become token budgets, and each source fills its budget with passes over
its documents, block after block in an order drawn anew for each pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.session import stage

from .common import body, row_key, words

BLOCK_DOCS = 512
ROUNDS = 40


def token_counts(docs: DataFrame) -> DataFrame:
    """key, source_key, n (words) and copies (rows with that key) of the documents with words, as a stage table."""
    rows = docs.select(
        row_key().alias("key"),
        F.struct("source").alias("source_key"),
        F.size(words(body())).cast("long").alias("n"),
    ).where("n > 0")
    return stage(rows.groupBy("key", "source_key").agg(F.min("n").alias("n"), F.count("*").alias("copies")), "tokens")


def source_tokens(counts: DataFrame) -> DataFrame:
    """source_key, n_docs and tokens of every source that has tokens."""
    return counts.groupBy("source_key").agg(
        F.sum("copies").alias("n_docs"), F.sum(F.col("n") * F.col("copies")).alias("tokens")
    )


def _moments(sources: DataFrame, exponent: float) -> tuple[float, float]:
    """Entropy (nats) of the tempered weights, and the most passes over a source when none gets less than one."""
    share = F.col("tokens") / F.col("all")
    power = F.pow(share, F.lit(exponent))
    row = sources.agg(
        F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("zl"), F.max(power / share).alias("most"),
        F.min(power / share).alias("least"),
    ).first()
    if not row["z"]:
        return 0.0, 1.0
    return math.log(row["z"]) - row["zl"] / row["z"], row["most"] / row["least"]


def solve_exponent(
    sources: DataFrame, max_passes: float | None = None, entropy: float | None = None, rounds: int = ROUNDS
) -> float:
    """The exponent in [0, 1], by bisection over small aggregates of the source table.

    ``max_passes``: the flattest weights (smallest exponent) that repeat no source more often than that,
    budgets being such that every source is read at least once. ``entropy``: the largest exponent whose
    weights have at least that entropy in nats. If the end of the range satisfies the aim, it is the answer.
    """
    if (max_passes is None) == (entropy is None):
        raise ValueError("give max_passes or entropy")
    if max_passes is not None:
        low, high = 0.0, 1.0
        if _moments(sources, 0.0)[1] <= max_passes:
            return 0.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (low, mid) if _moments(sources, mid)[1] <= max_passes else (mid, high)
        return high
    low, high = 0.0, 1.0
    if _moments(sources, 1.0)[0] >= entropy:
        return 1.0
    if _moments(sources, 0.0)[0] < entropy:
        raise ValueError("the sources' entropy cannot reach the target")
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if _moments(sources, mid)[0] >= entropy else (low, mid)
    return low


def weights(sources: DataFrame, max_passes: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """``sources`` with weight and budget (tokens), as a stage table.

    Without ``budget`` the total is the least that gives every source one whole pass.
    """
    n_all = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).first()[0]
    live = stage(sources.withColumn("all", F.lit(n_all)), "sources")
    exponent = solve_exponent(live, max_passes, entropy) if n_all else 1.0
    share = F.col("tokens") / F.lit(float(max(n_all, 1)))
    power = F.pow(share, F.lit(exponent))
    z, least = live.select(F.sum(power), F.min(power / share)).first() if n_all else (1.0, 1.0)
    if budget is None:
        budget = n_all * (z / least)
    out = live.withColumn("weight", power / F.lit(z))
    return stage(out.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long")), "weights")


def _draw(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(
    docs: DataFrame,
    max_passes: float | None = None,
    entropy: float | None = None,
    budget: int | None = None,
    block_docs: int = BLOCK_DOCS,
    seed: int = 7,
) -> DataFrame:
    """``docs``, each row once for every time it is drawn, plus epoch (long, from 0) and position (double).

    Each pass over a source permutes its blocks and the documents in each block anew. Passes are taken whole
    while the budget lasts; of the last one, blocks and then documents up to and including the one with which
    the budget is reached. position is the share of its source's budget that was filled before the row, so
    ordering by it interleaves the sources at their weights. Documents without words are dropped, as they
    hold no tokens; a null source is a source of its own; rows with one id and one text are drawn each for
    itself; an empty table gives an empty result. Columns named epoch or position are replaced.
    """
    counts = token_counts(docs)
    plan = weights(source_tokens(counts), max_passes, entropy, budget)
    sized = plan.where("budget > 0").select(
        "source_key",
        "tokens",
        "budget",
        F.ceil(F.col("n_docs") / block_docs).cast("long").alias("n_blocks"),
        F.ceil(F.col("budget") / F.col("tokens")).cast("long").alias("passes"),
    )
    rows = counts.join(sized.select("source_key", "n_blocks"), "source_key")
    rows = rows.withColumn("block", F.pmod(_draw(seed, F.col("key")), F.col("n_blocks"))).drop("n_blocks")

    blocks = rows.groupBy("source_key", "block").agg(F.sum(F.col("n") * F.col("copies")).alias("size"))
    blocks = blocks.join(sized.select("source_key", "tokens", "budget", "passes"), "source_key")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    blocks = blocks.withColumn("order", _draw(seed, F.col("block"), F.col("epoch")))
    # block totals only: one row for each block_docs documents and pass
    before = F.sum("size").over(
        Window.partitionBy("source_key", "epoch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("epoch") * F.col("tokens") + F.coalesce(before, F.lit(0))
    blocks = blocks.withColumn("start", start).where("start < budget")
    blocks = stage(blocks.select("source_key", "block", "epoch", "start", "budget"), "blocks")

    drawn = rows.join(blocks, ["source_key", "block"])
    drawn = drawn.withColumn("order", _draw(seed, F.col("key"), F.col("epoch")))
    within = F.sum(F.col("n") * F.col("copies")).over(
        Window.partitionBy("source_key", "block", "epoch").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    )
    drawn = drawn.withColumn("at", F.col("start") + F.coalesce(within, F.lit(0))).where("at < budget")
    drawn = drawn.groupBy("key", "source_key").agg(
        F.sort_array(F.collect_list(F.struct("epoch", (F.col("at") / F.col("budget")).alias("position")))).alias("draws")
    )
    out = docs.select(F.struct("*").alias("row"), row_key().alias("key"), F.struct("source").alias("source_key"))
    out = out.join(drawn, ["key", "source_key"]).select("row", F.explode("draws").alias("d"))
    kept = [c for c in docs.columns if c not in ("epoch", "position")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "d.epoch", "d.position")
