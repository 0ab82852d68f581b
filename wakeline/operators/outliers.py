"""Distance-to-the-k-th-neighbour outlier scores per ship, exact for ships of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stage
from .ordering import with_position
from .quantiles import grouped_quantiles, value_bins
from .sized import HEAVY_ROWS, all_of, attach, spread

MAX_K = 100
K_SHARE = 0.1
CONTAMINATION = 0.1
CELL_POINTS = 4096
BLOCK_ROWS = 20_000
FANOUT = 16


def neighbour_count(n: str | Column = "_n", max_k: int = MAX_K, share: float = K_SHARE) -> Column:
    """k = min(max_k, int(share * n))."""
    n = F.col(n) if isinstance(n, str) else n
    return F.least(F.lit(max_k).cast("long"), F.floor(n * F.lit(share)))


def _weighted_points(df: DataFrame, key: str, cols: list[str], max_k: int, share: float) -> DataFrame:
    """Distinct points with multiplicity ``_w`` and their ship's ``_k``; keys too small for k >= 1 drop out."""
    points = (
        df.where(all_of([F.col(c).isNotNull() for c in cols]))
        .groupBy(key, *[F.col(c).cast("double").alias(c) for c in cols])
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    points = stage(points, "knn-points")
    sizes = points.groupBy(key).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_m"))
    sizes = sizes.withColumn("_k", neighbour_count("_n", max_k, share)).where("_k >= 1")
    return attach(points, sizes.select(key, "_k", "_m"), [key], "inner")


def _back_to_rows(
    df: DataFrame, scores: DataFrame, points: DataFrame, key: str, cols: list[str], how: str = "left"
) -> DataFrame:
    """Scores per distinct point, given to all rows at that point; points with very many rows are known."""
    types = {c: df.schema[c].dataType for c in cols}
    typed = scores.withColumns({c: F.col(c).cast(k) for c, k in types.items()})
    heavy = points.where(F.col("_w") > HEAVY_ROWS).withColumns({c: F.col(c).cast(k) for c, k in types.items()})
    return attach(df, typed, [key, *cols], how, heavy=heavy)


# --------------------------------------------------------------------------- one column


def knn_score_1d(
    df: DataFrame,
    col: str,
    key: str = "ship_id",
    max_k: int = MAX_K,
    share: float = K_SHARE,
    out: str = "outlier_score",
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Add the distance to the k-th nearest other value of the same ship.

    In sorted order the k nearest are a window of k + 1 neighbours around the value, so blocks of
    sorted positions with k extra positions on either side give the exact answer. A value
    occurring more than k + 1 times needs only k + 1 of its copies.
    """
    scores, points = _value_scores(df, col, key, max_k, share, out, block_rows, hot_rows)
    return _back_to_rows(df, scores, points, key, [col])


def _value_scores(
    df: DataFrame, col: str, key: str = "ship_id", max_k: int = MAX_K, share: float = K_SHARE, out: str = "outlier_score",
    block_rows: int = BLOCK_ROWS, hot_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """One row per ship and value with its score, and the weighted points."""
    points = _weighted_points(df, key, [col], max_k, share)
    copies = points.select(
        key, col, "_k", "_m", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_w"), F.col("_k") + 1))).alias("_i")
    )
    binned = value_bins(copies, [key], col, hot_rows)
    placed = with_position(binned, [key], [col, "_i"], F.col("_bin"), "_pos", "_size")
    own = F.floor((F.col("_pos") - 1) / F.lit(block_rows))
    low = F.floor(F.greatest(F.col("_pos") - 1 - F.col("_k"), F.lit(0)) / F.lit(block_rows))
    high = F.floor(F.least(F.col("_pos") - 1 + F.col("_k"), F.col("_size") - 1) / F.lit(block_rows))
    blocks = placed.select(
        key, col, "_k", "_pos", own.alias("_own"), F.explode(F.sequence(low, high)).alias("_block")
    )
    schema = T.StructType(
        [df.schema[key], T.StructField(col, T.DoubleType()), T.StructField("_score", T.DoubleType())]
    )

    def score(table: pa.Table) -> pa.Table:
        order = np.argsort(table["_pos"].to_numpy())
        x, k = table[col].to_numpy()[order], table["_k"][0].as_py()
        padded = np.concatenate([np.full(k, -np.inf), x, np.full(k, np.inf)])
        n = len(x)
        best = np.full(n, np.inf)
        for back in range(k + 1):
            left = x - padded[k - back : k - back + n]
            right = padded[2 * k - back : 2 * k - back + n] - x
            np.minimum(best, np.maximum(left, right), out=best)
        mine = (table["_own"].to_numpy() == table["_block"].to_numpy())[order]
        values, at = np.unique(x[mine], return_index=True)
        same_key = table[key].slice(0, len(values))
        return pa.table({key: same_key, col: values, "_score": best[mine][at]})

    scores = spread(blocks, key, "_block").groupBy(key, "_block").applyInArrow(score, schema)
    return scores.groupBy(key, col).agg(F.min("_score").alias(out)), points


# ------------------------------------------------------------------------ several columns


def knn_score(
    df: DataFrame,
    cols: list[str],
    key: str = "ship_id",
    max_k: int = MAX_K,
    share: float = K_SHARE,
    out: str = "outlier_score",
    cell_points: int = CELL_POINTS,
) -> DataFrame:
    """Add the Euclidean distance to the k-th nearest other row of the same ship.

    Ships of at most ``cell_points`` distinct points are scored in one group each. Larger ships are
    cut into box-shaped cells; a first pass inside each cell bounds every point's radius, and a
    second pass visits exactly the cells that reach into it.
    """
    points = stage(_weighted_points(df, key, cols, max_k, share), "knn-weighted")
    fields = [df.schema[key], *[T.StructField(c, T.DoubleType()) for c in cols]]
    cold = points.where(F.col("_m") <= cell_points)
    scores = spread(cold, key).groupBy(key).applyInArrow(
        _score_group(key, cols, out), T.StructType([*fields, T.StructField(out, T.DoubleType())])
    )
    hot = points.where(F.col("_m") > cell_points)
    if not hot.isEmpty():
        scores = scores.unionByName(_score_cells(hot, key, cols, out, cell_points, fields))
    return _back_to_rows(df, scores, points, key, cols)


def _squares(q: np.ndarray, c: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Per block of queries: squared distances to all candidates."""
    step = max(1, 4_000_000 // max(len(c), 1))
    for start in range(0, len(q), step):
        part = slice(start, min(start + step, len(q)))
        d2 = np.zeros((part.stop - part.start, len(c)))
        for j in range(c.shape[1]):
            diff = q[part, j][:, None] - c[:, j][None, :]
            diff *= diff
            d2 += diff
        yield part, d2


def _nearest(q: np.ndarray, c: np.ndarray, w: np.ndarray, count: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per block of queries: distances to the nearest candidates in order, and their weights.

    Every candidate weighs at least one, so ``count`` of them always cover a total weight of ``count``.
    """
    take = min(count, len(c))
    for part, d2 in _squares(q, c):
        near = np.argpartition(d2, take - 1, axis=1)[:, :take]
        d = np.take_along_axis(d2, near, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        yield part, np.sqrt(np.take_along_axis(d, order, axis=1)), w[np.take_along_axis(near, order, axis=1)]


def _score_group(key: str, cols: list[str], out: str):
    def score(table: pa.Table) -> pa.Table:
        x, w, k = np.column_stack([table[c].to_numpy() for c in cols]), table["_w"].to_numpy(), table["_k"][0].as_py()
        kth = np.empty(len(x))
        # the row itself is among its candidates at distance 0, so the k-th other is the (k+1)-th
        if (w == 1).all():
            for part, d2 in _squares(x, x):
                d2.partition(k, axis=1)
                kth[part] = np.sqrt(d2[:, k])
        else:
            for part, d, wt in _nearest(x, x, w, k + 1):
                at = (np.cumsum(wt, axis=1) >= k + 1).argmax(axis=1)
                kth[part] = d[np.arange(len(d)), at]
        return table.select([key, *cols]).append_column(out, pa.array(kth))

    return score


def _lists(d: np.ndarray, wt: np.ndarray, count: int, reach: np.ndarray) -> list[list[float]]:
    """Distances repeated by weight, at most ``count`` per query and none beyond its reach."""
    return [np.repeat(row[row <= r], np.minimum(w[row <= r], count))[:count].tolist() for row, w, r in zip(d, wt, reach)]


def _score_cells(
    points: DataFrame, key: str, cols: list[str], out: str, limit: int, fields: list[T.StructField]
) -> DataFrame:
    pts, levels = _cut_cells(points.drop("_m"), key, cols, limit)
    id_fields = [*fields, T.StructField("_k", T.LongType())]
    list_field = T.StructField("_near", T.ArrayType(T.DoubleType()))
    own_schema = T.StructType([*id_fields, T.StructField("_cell", T.StringType()), T.StructField("_reach", T.DoubleType()), list_field])

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, k = pdf[cols].to_numpy(), pdf["_w"].to_numpy(), int(pdf["_k"].iloc[0])
        # A small cell's parent holds more than k + 1 points, all within the distance to its far corner.
        far = np.maximum(np.abs(x - pdf[[f"_plo_{c}" for c in cols]].to_numpy()),
                         np.abs(pdf[[f"_phi_{c}" for c in cols]].to_numpy() - x))
        reach = np.sqrt((far * far).sum(axis=1))
        near: list[list[float]] = []
        for part, d, wt in _nearest(x, x, w, k + 1):
            enough = np.cumsum(wt, axis=1) >= k + 1
            kth = np.where(enough.any(axis=1), d[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
            reach[part] = np.minimum(reach[part], kth)
            near += _lists(d, wt, k + 1, reach[part])
        return pd.DataFrame({**{c: pdf[c] for c in [key, *cols, "_k", "_cell"]}, "_reach": reach, "_near": near})[
            [key, *cols, "_k", "_cell", "_reach", "_near"]
        ]

    # parent boxes ride along with the points
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    nodes = stage(nodes, "knn-nodes")
    parent_box = nodes.select(
        key,
        F.col("_cell").alias("_parent"),
        *[F.col(f"_lo_{c}").alias(f"_plo_{c}") for c in cols],
        *[F.col(f"_hi_{c}").alias(f"_phi_{c}") for c in cols],
    )
    with_parent = attach(pts.withColumn("_parent", _parent_of("_cell")), parent_box, [key, "_parent"], "inner")
    first = stage(spread(with_parent, key, "_cell").groupBy(key, "_cell").applyInPandas(own, own_schema), "knn-own")

    # Descend the tree from the root, keeping for each leaf the nodes its farthest-reaching point may need.
    leaves = nodes.where(F.col("_n") <= limit)
    reach = first.groupBy(key, "_cell").agg(F.max("_reach").alias("_reach"))
    front = leaves.join(reach, [key, "_cell"]).select(
        key,
        F.col("_cell").alias("_q"),
        "_reach",
        *[F.col(f"_lo_{c}").alias(f"_qlo_{c}") for c in cols],
        *[F.col(f"_hi_{c}").alias(f"_qhi_{c}") for c in cols],
        F.lit("r").alias("_node"),
    )
    found = None
    for level in levels[1:]:
        child = level.withColumn("_node", _parent_of("_cell"))
        met = front.join(child, [key, "_node"])
        gap2 = sum(
            (_outside(F.col(f"_qlo_{c}"), F.col(f"_qhi_{c}"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols),
            F.lit(0.0),
        )
        met = stage(met.where(F.sqrt(gap2) <= F.col("_reach")), "knn-front")
        boxes = [f"_lo_{c}" for c in cols] + [f"_hi_{c}" for c in cols]
        done = met.where((F.col("_n") <= limit) & (F.col("_cell") != F.col("_q"))).select(
            key, "_q", F.col("_cell").alias("_c"), *boxes
        )
        found = done if found is None else found.unionByName(done)
        front = met.where(F.col("_n") > limit).select(*front.columns[:-1], F.col("_cell").alias("_node"))
    pairs = stage(found, "knn-pairs")

    gap2 = sum((_outside(F.col(c), F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols), F.lit(0.0))
    asking = (
        first.select(key, *cols, "_k", F.col("_cell").alias("_q"), "_reach")
        .join(pairs, [key, "_q"])
        .where(F.sqrt(gap2) <= F.col("_reach"))
        .select(key, "_q", "_c", *cols, "_k", "_reach")
    )
    offered = pts.select(key, F.col("_cell").alias("_c"), *cols, "_w").join(pairs.select(key, "_q", "_c"), [key, "_c"])
    pair_schema = T.StructType([*id_fields, list_field])

    def across(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({f.name: [] for f in pair_schema})
        k = int(qs["_k"].iloc[0])
        near: list[list[float]] = []
        bound = qs["_reach"].to_numpy()
        for part, d, wt in _nearest(qs[cols].to_numpy(), cs[cols].to_numpy(), cs["_w"].to_numpy(), k + 1):
            near += _lists(d, wt, k + 1, bound[part])
        return pd.DataFrame({**{c: qs[c] for c in [key, *cols, "_k"]}, "_near": near})[[key, *cols, "_k", "_near"]]

    pair = [key, "_q", "_c"]
    second = (
        spread(asking, *pair).groupBy(*pair).cogroup(spread(offered, *pair).groupBy(*pair)).applyInPandas(across, pair_schema)
    )
    lists = first.select(key, *cols, "_k", "_near").unionByName(second)
    merged = lists.groupBy(key, *cols, "_k").agg(F.array_sort(F.flatten(F.collect_list("_near"))).alias("_near"))
    return merged.select(key, *cols, F.element_at("_near", (F.col("_k") + 1).cast("int")).alias(out))


def _outside(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Squared gap between two intervals, 0 where they meet."""
    gap = F.greatest(blo - ahi, alo - bhi, F.lit(0.0))
    return gap * gap


def _parent_of(cell: str) -> Column:
    return F.regexp_replace(F.col(cell), r"\.[0-9]+$", "")


def _cut_cells(points: DataFrame, key: str, cols: list[str], limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf cell, and the nodes of each tree level with bounding boxes.

    A cell above ``limit`` points is cut along its widest column at sketch quantiles. Its minimum and
    middle are cut points too, so every cut makes progress, whatever the distribution.
    """
    pts = stage(points.withColumn("_cell", F.lit("r")), "knn-cut")
    levels: list[DataFrame] = []
    while True:
        depth = len(levels)
        nodes = pts.groupBy(key, "_cell").agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.min(c).alias(f"_lo_{c}") for c in cols],
            *[F.max(c).alias(f"_hi_{c}") for c in cols],
        )
        made_here = F.size(F.split("_cell", r"\.")) == depth + 1
        nodes = stage(nodes.where(made_here), "knn-level")
        levels.append(nodes)
        big = nodes.where(F.col("_n") > limit)
        if big.isEmpty():
            return pts, levels
        spans = F.array(*[F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in cols])
        dim = F.array_position(spans, F.array_max(spans)).cast("int")
        lo = F.element_at(F.array(*[F.col(f"_lo_{c}") for c in cols]), F.col("_dim"))
        hi = F.element_at(F.array(*[F.col(f"_hi_{c}") for c in cols]), F.col("_dim"))
        chosen = big.withColumn("_dim", dim).select(key, "_cell", "_dim", lo.alias("_min"), ((lo + hi) / 2).alias("_mid"))
        value = F.element_at(F.array(*[F.col(c) for c in cols]), F.col("_dim"))
        inside = attach(pts, chosen, [key, "_cell"], "inner").withColumn("_v", value)
        cuts = inside.groupBy(key, "_cell", "_dim", "_min", "_mid").agg(
            F.percentile_approx("_v", [i / FANOUT for i in range(1, FANOUT)], 1000).alias("_cuts")
        )
        cuts = cuts.select(
            key, "_cell", "_dim",
            F.array_sort(F.array_distinct(F.concat("_cuts", F.array("_min", "_mid")))).alias("_cuts"),
        )
        met = attach(pts, cuts, [key, "_cell"]).withColumn("_v", value)
        child = F.concat_ws(".", "_cell", F.size(F.filter("_cuts", lambda s: s < F.col("_v"))).cast("string"))
        pts = stage(
            met.withColumn("_cell", F.when(F.col("_dim").isNull(), F.col("_cell")).otherwise(child)).select(*pts.columns),
            "knn-cut",
        )


# ---------------------------------------------------------------------- labels and reports


def outlier_label(
    df: DataFrame,
    score: str = "outlier_score",
    key: str = "ship_id",
    contamination: float = CONTAMINATION,
    out: str = "outlier_label",
) -> DataFrame:
    """1 where the score exceeds the ship's (1 - contamination) quantile."""
    cut = grouped_quantiles(df, [key], score, [1 - contamination]).select(key, F.col("quantiles")[0].alias("_cut"))
    return attach(df, cut, [key]).withColumn(out, (F.col(score) > F.col("_cut")).cast("int")).drop("_cut")


def single_filter(df: DataFrame, limits: dict[str, float], key: str = "ship_id", digits: int = 6) -> DataFrame:
    """Rows whose single-column score is below the limit on every listed column; scores are compared rounded.

    Every score is that among all rows, so each is found from ``df`` alone and only the values within the limit are
    looked up.
    """
    kept, scale = df, float(10**digits)
    for c, limit in limits.items():
        scores, points = _value_scores(df, c, key)
        near = scores.where(F.floor(F.col("outlier_score") * scale + 0.5) / scale < limit).select(key, c)
        kept = _back_to_rows(kept, near, points, key, [c], "left_semi")
    return kept


def outlier_audit(df: DataFrame, score: str = "outlier_score", levels: tuple[float, ...] = (1.0, 3.0)) -> DataFrame:
    return df.agg(
        *[
            (F.count_if(F.col(score) >= v) / F.count(F.lit(1))).alias(f"share_ge_{v:g}")
            for v in levels
        ],
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )


def principal_components(df: DataFrame, cols: list[str], key: str = "ship_id") -> DataFrame:
    """Per key: means, deviations, and the components of the correlation matrix by falling variance.

    One aggregate carries every key's means, deviations and correlations; the small symmetric matrices are
    decomposed in batches, a row a key. A component's entry of largest size is positive. Constant columns have no
    part in any component of positive variance.
    """
    n = len(cols)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    whole = df.where(all_of([F.col(c).isNotNull() for c in cols]))
    moments = whole.groupBy(key).agg(
        F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[F.stddev_pop(c) for c in cols]).alias("stds"),
        F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("covs"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            std = np.stack(pdf["stds"].to_numpy()).astype(float)
            m = np.zeros((len(pdf), n, n))
            m[:, np.arange(n), np.arange(n)] = std > 0
            covs = np.stack(pdf["covs"].to_numpy()).astype(float)
            for at, (i, j) in enumerate(pairs):
                both = std[:, i] * std[:, j]
                m[:, i, j] = m[:, j, i] = np.where(both > 0, covs[:, at] / np.where(both > 0, both, 1.0), 0.0)
            values, vectors = np.linalg.eigh(m)
            values, vectors = values[:, ::-1], vectors[:, :, ::-1].transpose(0, 2, 1)
            lead = np.take_along_axis(vectors, np.abs(vectors).argmax(2)[:, :, None], 2)
            vectors = vectors * np.where(lead < 0, -1.0, 1.0)
            total = values.sum(1, keepdims=True)
            shares = np.where(total > 0, values / np.where(total > 0, total, 1.0), 0.0)
            yield pdf[[key, "means", "stds"]].assign(components=[v.tolist() for v in vectors], shares=shares.tolist())

    kind = df.schema[key].dataType.simpleString()
    return moments.mapInPandas(
        solve, f"{key} {kind}, means array<double>, stds array<double>, components array<array<double>>, shares array<double>"
    )


def pca_outlier(df: DataFrame, cols: list[str], components: int = 2, key: str = "ship_id", out: str = "outlier_score") -> DataFrame:
    """Per ship: the distances of the standardised row to the leading unit components, each over its share of variance, summed.

    NULL where a column is, and where a wanted component has no variance.
    """
    held = attach(df, principal_components(df, cols, key).withColumnRenamed("components", "axes"), [key])
    z = [(F.col(c) - F.col("means")[i]) / F.when(F.col("stds")[i] == 0, F.lit(1.0)).otherwise(F.col("stds")[i]) for i, c in enumerate(cols)]
    score = F.lit(0.0)
    for k in range(components):
        apart = F.sqrt(sum(((zi - F.col("axes")[k][i]) * (zi - F.col("axes")[k][i]) for i, zi in enumerate(z)), F.lit(0.0)))
        score = score + F.when(F.col("shares")[k] > 1e-12, apart / F.col("shares")[k])
    return held.withColumn(out, score).select(*df.columns, out)
