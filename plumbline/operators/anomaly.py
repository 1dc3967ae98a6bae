"""Anomaly detection: isolation forest, IQR fences and z-scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, hash32
from plumbline.functions.frames import deal_out, materialise
from plumbline.functions.scalar import percent, round_stat
from plumbline.plans.stats import TableStats, stats_of

SAMPLE_PER_TREE = 256
CONTAMINATION = 0.05
SEED = 42
SAMPLE_ROWS = 20
SERIES_ROWS = 500
INDEX_ROWS = 100

NODES = "tree int, node int, feature int, threshold double, left int, right int, depth int, size bigint"


def _numeric_or_raise(st: TableStats) -> None:
    if not st.numeric:
        raise ValueError("anomaly detection needs at least one numeric column")


def impute_scale(table: DataFrame | TableStats, key: list[str]) -> DataFrame:
    """Key columns, and every other numeric column median-filled and standardised."""
    st = stats_of(table)
    _numeric_or_raise(st)
    names = [c.name for c in st.numeric if c.name not in key]
    filled = _imputed(st, names).select(*[col(k) for k in key], *[col(c) for c in names])
    stats = TableStats(filled.select(*[col(c) for c in names])).moments
    scaled = []
    for c in names:
        m = stats[c]
        std = m["std"] * math.sqrt((m["n"] - 1) / m["n"]) if m["std"] else 1.0
        scaled.append(round_stat((col(c) - (m["mean"] or 0.0)) / std, 6).alias(c))
    return filled.select(*[col(k) for k in key], *scaled)


def _imputed(st: TableStats, names: list[str]) -> DataFrame:
    """The table with gaps in numeric columns replaced by the median (0 when
    a column has no value at all)."""
    medians = st.quantiles([0.5], [c for c in names if c not in st.complete])
    fill = {c: (m[0] if m[0] is not None else 0.0) for c, m in medians.items()}
    return st.df.select(
        *[
            (F.coalesce(col(c.name).cast("double"), F.lit(fill[c.name])).alias(c.name) if c.name in fill
             else col(c.name).cast("double").alias(c.name) if c.name in names else col(c.name))
            for c in st.columns
        ]
    )


# -- isolation forest -----------------------------------------------------


def tree_count(rows: int) -> int:
    return min(100, max(10, rows // 10))


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits down to single points, equal points or the depth limit."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes, todo = [], [(0, np.arange(len(points)), 0)]
    taken = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(spread):
            nodes.append((node, -1, 0.0, -1, -1, depth, len(rows)))
            continue
        feature = int(rng.choice(spread))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = points[rows, feature] <= cut
        nodes.append((node, feature, cut, taken, taken + 1, depth, len(rows)))
        todo += [(taken, rows[left], depth + 1), (taken + 1, rows[~left], depth + 1)]
        taken += 2
    return nodes


def draw_numbers(h: np.ndarray, trees: int) -> np.ndarray:
    """A number below 2**32 for every row, of hash ``h``, in every tree: the finishing mix of MurmurHash3."""
    step = np.uint64(2**32)
    m = (h.astype(np.uint64)[:, None] + np.arange(trees, dtype=np.uint64)[None, :] * np.uint64(2654435769)) % step
    m = ((m ^ (m >> np.uint64(16))) * np.uint64(2246822507)) % step
    m = ((m ^ (m >> np.uint64(13))) * np.uint64(3266489909)) % step
    return m ^ (m >> np.uint64(16))


def _drawn(trees: int, per_tree: int, ceiling: int):
    """Each task's first ``per_tree`` rows of every tree, by draw and identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            draws = draw_numbers(batch.column("h").to_numpy(), trees)
            row, tree = np.nonzero(draws <= ceiling)
            if not len(row):
                continue
            at = pa.array(row)
            mine = pa.table({"tree": pa.array(tree.astype(np.int32)), "draw": pa.array(draws[row, tree].astype(np.int64)), "identity": batch.column("identity").take(at), "x": batch.column("x").take(at)})
            kept = mine if kept is None else pa.concat_tables([kept, mine])
            if kept.num_rows > 4 * trees * per_tree:
                kept = first(kept)
        if kept is not None:
            yield from first(kept).combine_chunks().to_batches()

    def first(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("tree", "ascending"), ("draw", "ascending"), ("identity", "ascending")])
        tree = rows.column("tree").to_numpy()[order.to_numpy()]
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        place = np.arange(len(tree)) - np.repeat(starts, np.diff(np.r_[starts, len(tree)]))
        return rows.take(order.filter(pa.array(place < per_tree)))

    return run


def forest_draws(table: DataFrame | TableStats, key: list[str]) -> DataFrame:
    """``tree, draw, identity, x``: the rows that each tree of the forest grows from.

    Every tree takes the rows with its smallest numbers, which follow from a hash
    of the row key, so a retried task draws the same rows. A task sends no more
    than a tree needs, and on a large table only numbers below four times the
    share that is needed.
    """
    st = stats_of(table)
    _numeric_or_raise(st)
    rows = st.counts["rows"]
    trees, per_tree = tree_count(rows), min(SAMPLE_PER_TREE, rows)
    names = [c.name for c in st.numeric if c.name not in key]
    identity = F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key])
    ceiling = int(min(1.0, 4 * per_tree / max(rows, 1)) * 2**32)
    points = _imputed(st, names).select(hash32(identity).alias("h"), identity.alias("identity"), F.array(*[col(c) for c in names]).alias("x"))
    drawn = points.mapInArrow(_drawn(trees, per_tree, ceiling), "tree int, draw bigint, identity string, x array<double>")
    order = Window.partitionBy("tree").orderBy("draw", "identity")
    return drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_tree).drop("place")


def iforest_trees(table: DataFrame | TableStats, key: list[str], seed: int = SEED) -> DataFrame:
    """Node table of an isolation forest: at most 100 trees of 511 nodes, each grown from its own draw."""

    def grow(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(keys[0])
        chosen = pdf.sort_values(["draw", "identity"])
        points = np.array(chosen["x"].tolist(), dtype=float)
        nodes = grow_tree(points, np.random.default_rng([seed, tree]))
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth", "size"])
        frame.insert(0, "tree", tree)
        return frame

    return forest_draws(table, key).groupBy("tree").applyInPandas(grow, NODES)


def _score(df: DataFrame, names: list[str], nodes: pd.DataFrame, sample: int) -> DataFrame:
    """Anomaly score 2^(-E[depth] / c(sample)) of every row. The bounded node
    table travels with the task; rows stay where they are."""
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        depth = t["depth"].to_numpy() + _average_path(t["size"].to_numpy())
        trees.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), depth))
    norm = float(_average_path(np.array([sample]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        points = np.array(x.tolist(), dtype=float).reshape(len(x), len(names))
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for feature, cut, left, right, depth in trees:
            at = np.zeros(len(points), dtype=int)
            while True:
                split = feature[at] >= 0
                if not split.any():
                    break
                go_left = points[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(split, np.where(go_left, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(trees) / norm))

    return df.withColumn("raw_score", score(F.array(*[col(c) for c in names])))


def iforest_scores(
    table: DataFrame | TableStats, key: list[str], contamination: float = CONTAMINATION, seed: int = SEED
) -> DataFrame:
    """Every row with its score above the cut (higher = more anomalous) and
    whether it belongs to the top ``contamination`` share."""
    st = stats_of(table)
    _numeric_or_raise(st)
    names = [c.name for c in st.numeric if c.name not in key]
    nodes = iforest_trees(st, key, seed).toPandas()
    scored = _score(deal_out(_imputed(st, names), key), names, nodes, min(SAMPLE_PER_TREE, st.counts["rows"]))
    # scored once: the cut needs all scores, and the result needs them again
    kept = materialise(scored.select(*[col(k) for k in key], "raw_score"), "scores")
    cut = TableStats(kept.select("raw_score")).quantiles([1 - contamination])["raw_score"][0]
    return kept.select(
        *[col(k) for k in key],
        F.round(F.col("raw_score") - F.lit(cut), 4).alias("anomaly_score"),
        (F.col("raw_score") > F.lit(cut)).alias("is_anomaly"),
    )


# -- fences and z-scores --------------------------------------------------


def _outside(bounds: dict[str, tuple[float, float]], name: str) -> Column:
    if name not in bounds:
        return F.lit(False)
    lower, upper = bounds[name]
    x = col(name).cast("double")
    return F.coalesce((x < lower) | (x > upper), F.lit(False))


def _any(flags: list[Column]) -> Column:
    return reduce(Column.__or__, flags, F.lit(False))


def iqr_row_flags(table: DataFrame | TableStats, key: list[str]) -> DataFrame:
    """Per row, whether each numeric cell lies outside its IQR fences."""
    st = stats_of(table)
    bounds = st.iqr_bounds()
    flags = {c.name: _outside(bounds, c.name) for c in st.numeric if c.name not in key}
    return st.df.select(
        *[col(k) for k in key], *[f.alias(f"{c}_outlier") for c, f in flags.items()], _any(list(flags.values())).alias("row_outlier")
    )


def zscore_flags(table: DataFrame | TableStats, key: list[str], limit: float = 3.0) -> DataFrame:
    """Per row, whether each numeric cell is over ``limit`` deviations from the mean."""
    st = stats_of(table)
    flags = {c.name: _z_outside(st, c.name, limit) for c in st.numeric if c.name not in key}
    return st.df.select(
        *[col(k) for k in key], *[f.alias(f"{c}_outlier") for c, f in flags.items()], _any(list(flags.values())).alias("row_outlier")
    )


def _z_outside(st: TableStats, name: str, limit: float) -> Column:
    m = st.moments[name]
    if m["n"] < 5 or not m["std"]:
        return F.lit(False)
    z = (col(name).cast("double") - m["mean"]) / m["std"]
    return F.coalesce(F.abs(z) > limit, F.lit(False))


def iqr_column_summary(table: DataFrame | TableStats) -> DataFrame:
    """Per column with outliers: count, percent of all rows, fences and range."""
    return stats_of(table).fence_frame().where("guarded_outliers > 0").select(
        "column", F.col("guarded_outliers").alias("count"), percent(F.col("guarded_outliers"), F.col("rows")).alias("pct"),
        round_stat(F.col("lower")).alias("lower_bound"), round_stat(F.col("upper")).alias("upper_bound"),
        round_stat(F.col("out_min")).alias("min_anomaly"), round_stat(F.col("out_max")).alias("max_anomaly"),
    )


def anomaly_summary(table: DataFrame | TableStats, key: list[str] = (), scores: DataFrame | None = None) -> DataFrame:
    """Rows flagged by each cell-wise method, and their share; with ``scores``
    also those that the forest flags. Key columns are not judged."""
    st = stats_of(table)
    st.together(lambda: st.quartiles(), lambda: st.moments)
    iqr, names = st.iqr_bounds(), [c.name for c in st.numeric if c.name not in key]
    counted = st.df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(_any([_outside(iqr, c) for c in names])).alias("iqr_rows"),
        F.count_if(_any([_z_outside(st, c, 3.0) for c in names])).alias("zscore_rows"),
    )
    summary = counted.select(
        "*", percent(F.col("iqr_rows"), F.col("total_rows")).alias("iqr_pct"),
        percent(F.col("zscore_rows"), F.col("total_rows")).alias("zscore_pct"),
    )
    if scores is None:
        return summary
    return summary.crossJoin(iforest_summary(scores).drop("total_rows"))  # one row each


def iforest_summary(scores: DataFrame) -> DataFrame:
    """Rows that the forest flags, and their share."""
    counted = scores.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("is_anomaly").alias("iforest_rows"))
    return counted.withColumn("iforest_pct", percent(F.col("iforest_rows"), F.col("total_rows")))


def flagged_keys(scores: DataFrame, key: list[str], limit: int = INDEX_ROWS) -> DataFrame:
    """Keys of the first flagged rows."""
    return scores.where("is_anomaly").orderBy(*[col(k) for k in key]).limit(limit).select(*[col(k) for k in key])


def anomaly_sample(table: DataFrame | TableStats, scores: DataFrame, key: list[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first flagged rows as text, with their scores."""
    st = stats_of(table)
    first = scores.where("is_anomaly").orderBy(*[col(k) for k in key]).limit(limit)
    rows = st.df.join(F.broadcast(first), key)
    return rows.select(
        *[F.coalesce(col(c.name).cast("string"), F.lit("")).alias(c.name) for c in st.columns], "anomaly_score"
    )


def anomaly_series(scores: DataFrame, key: list[str], limit: int = SERIES_ROWS) -> DataFrame:
    """Score and flag of the first rows."""
    return scores.orderBy(*[col(k) for k in key]).limit(limit)
