"""Joining rows with a small per-key table without trusting that it is small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

BROADCAST_ROWS = 200_000
HEAVY_ROWS = 5_000_000
BROADCAST_BYTES = 64 << 20


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__{k}" for k in keys])


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    bound: int = BROADCAST_ROWS,
    heavy: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Join ``rows`` with ``table``, which holds at most one row per key.

    The table is written once and counted. Up to ``bound`` rows it is broadcast, so the rows are not
    shuffled at all. Beyond that it is a shuffle join, except for heavy keys: those with more than
    ``heavy_rows`` rows, of which there can be only (rows / heavy_rows), meet their part of the
    table by broadcast. ``heavy`` lists such keys where the caller knows them already.
    """
    table = stage(table, "attach")
    if table.count() <= bound:
        return null_safe_join(rows, F.broadcast(table), keys, how)
    if heavy is None:
        heavy = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows)
    heavy = stage(heavy.select(*keys), "heavy-keys")
    if heavy.isEmpty():
        return null_safe_join(rows, table, keys, how)
    few = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
    marked = null_safe_join(rows, few, keys, "left")
    hot_table = null_safe_join(table, few, keys, "left_semi")
    hot = null_safe_join(marked.where("_hot").drop("_hot"), F.broadcast(hot_table), keys, how)
    cold = null_safe_join(marked.where("_hot IS NULL").drop("_hot"), table, keys, how)
    return cold.unionByName(hot)


def small(table: DataFrame) -> DataFrame:
    """``table``, written once and counted; joins are told to broadcast it where its rows take up to BROADCAST_BYTES.

    For tables of numbers. Any number of rows may share a key.
    """
    table = stage(table, "small")
    fits = table.count() * (64 + 8 * len(table.columns)) <= BROADCAST_BYTES
    return F.broadcast(table) if fits else table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ahead of Python work. The explicit number keeps adaptive execution from
    folding groups that are small in bytes but costly in time into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
