"""Deep profile of every column."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, hash32
from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import percent, round_stat
from plumbline.plans import value_counts
from plumbline.plans.firsts import first_values
from plumbline.plans.stats import TableStats, stats_of


def profile_overview(table: DataFrame | TableStats) -> DataFrame:
    """Shape, missing cells and duplicates in one row."""
    st = stats_of(table)
    rows = st.counts["rows"]
    frame = small_frame(
        st.spark,
        [{
            "rows": rows, "columns": len(st.columns), "numeric_cols": len(st.numeric),
            "categorical_cols": len(st.categorical), "total_cells": rows * len(st.columns),
            "missing_cells": sum(rows - n for n in st.counts["non_null"].values()), "duplicate_rows": st.duplicates,
        }],
        "rows bigint, columns bigint, numeric_cols bigint, categorical_cols bigint, total_cells bigint, "
        "missing_cells bigint, duplicate_rows bigint",
    )
    return frame.withColumn("missing_pct", percent(F.col("missing_cells"), F.col("total_cells")))


# Bytes of a value of each fixed-width type.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def data_bytes(table: DataFrame | TableStats) -> DataFrame:
    """Bytes of data per column: fixed widths, and the length of text."""
    st = stats_of(table)
    sizes = [
        (F.count(col(c.name)) * WIDTHS[c.dtype] if c.dtype in WIDTHS else F.coalesce(F.sum(F.octet_length(col(c.name).cast("string")).cast("bigint")), F.lit(0)))
        .alias(f"b{c.pos}")
        for c in st.profiled
    ]
    totals = st.df.agg(*sizes)
    cells = F.array(*[F.struct(F.lit(c.name).alias("column"), F.col(f"b{c.pos}").cast("bigint").alias("bytes")) for c in st.profiled])
    return totals.select(F.inline(cells))


def profile_columns(table: DataFrame | TableStats) -> DataFrame:
    """Type, missing and distinct counts of every column."""
    st = stats_of(table)
    distinct = st.distinct(st.profiled)
    uniques = small_frame(
        st.spark, [{"column": c, "unique": n} for c, n in distinct.items()], "column string, unique bigint"
    )
    return st.missing_frame().join(uniques, "column").select(
        "column", "dtype", F.col("non_null").alias("count"), "missing",
        percent(F.col("missing"), F.col("rows")).alias("missing_pct"), "unique",
        percent(F.col("unique"), F.greatest(F.col("rows"), F.lit(1))).alias("unique_pct"),
    )


def profile_numeric(table: DataFrame | TableStats) -> DataFrame:
    """Moments, range and quartiles of every numeric column that has a value."""
    st = stats_of(table)
    st.together(lambda: st.moments, lambda: st.fences)
    frame = st.numeric_frame().join(st.fence_frame().select("pos", "q1", "median", "q3"), "pos").where("n > 0")
    derived = frame.withColumn("range", F.col("max") - F.col("min")).withColumn(
        "iqr", F.col("q3") - F.col("q1")
    ).withColumn("cv", F.try_divide("std", "mean"))
    names = ("mean", "std", "variance", "min", "max", "range", "q1", "median", "q3", "iqr", "skewness", "kurtosis", "cv")
    return derived.select("column", *[round_stat(F.col(c)).alias(c) for c in names])


def profile_outliers(table: DataFrame | TableStats) -> DataFrame:
    """IQR outliers without a guard: equal quartiles make every other value one."""
    return stats_of(table).fence_frame().where("n > 0").select(
        "column", F.coalesce("outliers", F.lit(0)).alias("outliers"),
        percent(F.coalesce("outliers", F.lit(0)), F.col("n")).alias("outlier_pct"),
    )


def profile_signs(table: DataFrame | TableStats) -> DataFrame:
    """Zeros and negatives of every numeric column that has a value."""
    return stats_of(table).numeric_frame().where("n > 0").select("column", "zeros", "negatives")


# -- normality ------------------------------------------------------------

SHAPIRO_ROWS = 500
SHAPIRO_LIMIT = 5000


def shapiro_p(values: np.ndarray) -> float:
    """Shapiro-Wilk p-value by Royston's approximation (1995)."""
    x = np.sort(values)
    n = len(x)
    if x[-1] == x[0]:
        return 1.0
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    c = m / math.sqrt(mm)
    a = np.empty(n)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    if n > 5:
        nxt = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[1], a[-2] = -nxt, nxt
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[0], a[-1] = -last, last
    w = float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum())
    if w >= 1:
        return 1.0
    if n <= 11:
        g = 0.459 * n - 2.273
        y = -math.log(g - math.log1p(-w))
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, logn = math.log1p(-w), math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], logn)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], logn))
    return 1 - normal.cdf((y - mu) / sigma)


def normality_shapiro(table: DataFrame | TableStats, key: list[str], limit: int = SHAPIRO_LIMIT) -> DataFrame:
    """Shapiro-Wilk p per numeric column on a hash-ranked sample of 500 values.

    NULL outside 4 < n <= ``limit``, as the test loses meaning on large
    samples; ``normality_jb`` answers at any size. Rows are ranked by a hash of
    ``key``; rows that share one (or have none) are told apart by their values,
    and each column offers its own share of rows.
    """
    st = stats_of(table)
    tested = [c for c in st.numeric if 4 < st.counts["non_null"][c.name] <= limit]
    base = small_frame(
        st.spark, [{"column": c.name, "n": st.counts["non_null"][c.name]} for c in st.numeric], "column string, n bigint"
    )
    if not tested:
        return base.select("column", "n", F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("boolean").alias("is_normal"))
    identity = F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key]).alias("key_")
    keep = st.df.select(identity, *[col(c.name) for c in st.numeric])
    long = value_counts.unpivot(keep, tested, ["key_"]).select(
        "column", "key_", F.coalesce("d", F.col("i").cast("double")).alias("value")
    )
    # only rows that can be among the smallest hashes go on to be ranked; where a
    # repeated key leaves too few of them, all rows of the column do
    draw = hash32(F.col("key_"))
    share = {c.name: min(1.0, 4.0 * SHAPIRO_ROWS / st.counts["non_null"][c.name]) for c in tested}
    offers = reduce(lambda x, c: x | ((F.col("column") == c) & (draw <= F.lit(int(share[c] * 2**32)))), share, F.lit(False))
    enough = {r["column"]: r["count"] for r in long.where(offers).groupBy("column").count().collect()}
    short = [c.name for c in tested if enough.get(c.name, 0) < min(SHAPIRO_ROWS, st.counts["non_null"][c.name])]
    order = Window.partitionBy("column").orderBy(draw, "key_", "value")
    offered = long.where(offers | F.col("column").isin(short)) if short else long.where(offers)
    sample = offered.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SHAPIRO_ROWS)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "p_value": [round(shapiro_p(pdf["value"].to_numpy()), 6)]})

    tested_p = sample.select("column", "value").groupBy("column").applyInPandas(test, "column string, p_value double")
    return base.join(tested_p, "column", "left").select("column", "n", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))


def normality_jb(table: DataFrame | TableStats) -> DataFrame:
    """Jarque-Bera test from the moments: one pass at any size."""
    jb = F.col("n") / 6 * (F.pow("g1", F.lit(2.0)) + F.pow("g2", F.lit(2.0)) / 4)
    return stats_of(table).numeric_frame().where("n > 4 AND g1 IS NOT NULL").select(
        "column", "n", round_stat(jb).alias("jb"), F.round(F.exp(-jb / 2), 6).alias("p_value"),
        (F.exp(-jb / 2) > 0.05).alias("is_normal"),
    )


def numeric_sample(table: DataFrame | TableStats, order_by: list[str], limit: int = 2000) -> DataFrame:
    """First ``limit`` values of every numeric column, in the given order."""
    st = stats_of(table)
    names = [c.name for c in st.numeric]
    found = first_values(st.df, names, order_by, limit)
    return found.select(F.get(F.array(*[F.lit(c) for c in names]), F.col("p")).alias("column"), "rank", "value")


# -- categories -----------------------------------------------------------


def category_top_k(table: DataFrame | TableStats, k: int = 20) -> DataFrame:
    """The ``k`` commonest values of every categorical column."""
    st = stats_of(table)
    return value_counts.top_k(st.value_counts(st.categorical), k).select(
        "column", "rank", F.col("s").alias("value"), F.col("cnt").alias("count")
    )


def category_summary(table: DataFrame | TableStats) -> DataFrame:
    """Top value, its share of the non-null values, and whether there are two values."""
    st = stats_of(table)
    return st.summary_frame(st.categorical).select(
        "column", "top_value", "top_freq",
        percent(F.col("top_freq"), F.greatest(F.col("non_null"), F.lit(1))).alias("top_freq_pct"),
        (F.col("distinct") == 2).alias("is_binary"),
    )


def category_entropy(table: DataFrame | TableStats) -> DataFrame:
    """Entropy of the value counts of every categorical column, in nats."""
    st = stats_of(table)
    return st.summary_frame(st.categorical).select("column", F.round(F.abs("entropy"), 4).alias("entropy"))


# -- pairs and shapes -----------------------------------------------------


def correlation_matrix(table: DataFrame | TableStats) -> DataFrame:
    """Pearson matrix in long form, both triangles and the diagonal."""
    st = stats_of(table)
    pairs = st.pair_frame().select("col1", "col2", "r")
    rows = [
        {"col1": c.name, "col2": c.name, "r": 1.0 if st.moments[c.name]["std"] else None} for c in st.numeric
    ]
    diagonal = small_frame(st.spark, rows, "col1 string, col2 string, r double")
    mirrored = pairs.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "r")
    return pairs.unionByName(mirrored).unionByName(diagonal).select("col1", "col2", F.round("r", 4).alias("r"))


def high_correlation(table: DataFrame | TableStats, above: float = 0.7) -> DataFrame:
    """Pairs whose |r| exceeds ``above``, strongest first."""
    size = F.abs("r")
    return (
        stats_of(table).pair_frame().where(size > above)
        .orderBy(size.desc(), "i", "j")
        .select("col1", "col2", F.round("r", 4).alias("correlation"), F.when(size > 0.9, "very strong").otherwise("strong").alias("strength"))
    )


def skewness_bands(table: DataFrame | TableStats) -> DataFrame:
    """Skewness of every numeric column and its band."""
    size = F.abs("skewness")
    return stats_of(table).numeric_frame().select(
        "column", F.round("skewness", 3).alias("skewness"),
        F.when(size > 2, "high").when(size > 1, "moderate").otherwise("low").alias("band"),
    )


def missing_pattern(table: DataFrame | TableStats, order_by: list[str], limit: int = 100) -> DataFrame:
    """0/1 missing flags of the first rows; empty when nothing is missing."""
    st = stats_of(table)
    first = st.df.orderBy(*[col(c) for c in order_by]).limit(limit).select(
        F.row_number().over(Window.orderBy(*[col(c) for c in order_by])).alias("row"),
        *[col(c.name).isNull().cast("int").alias(c.name) for c in st.columns],
    )
    if len(st.complete) == len(st.columns):
        first = first.limit(0)
    cells = F.array(*[F.struct(F.lit(c.name).alias("column"), col(c.name).alias("missing")) for c in st.columns])
    return first.select("row", F.inline(cells))


def column_search(table: DataFrame | TableStats, text: str) -> DataFrame:
    """Columns whose name contains ``text``, whatever the case, with their fill."""
    return stats_of(table).missing_frame().where(F.lower("column").contains(text.lower())).select(
        "column", "dtype", F.col("non_null").alias("count"), "missing"
    )
