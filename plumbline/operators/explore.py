"""The aggregates behind exploratory charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import round_stat
from plumbline.plans import value_counts
from plumbline.plans.stats import TableStats, stats_of

HISTOGRAM_COLUMNS = 6
BOX_COLUMNS = 8
BAR_COLUMNS = 3
BAR_VALUES = 15
SCATTER_POINTS = 2000


def bin_count(n: int) -> int:
    return min(30, max(10, n // 20))


def histogram(table: DataFrame | TableStats, columns: int = HISTOGRAM_COLUMNS) -> DataFrame:
    """Equal-width bins of the first numeric columns: one pass, whose partial
    aggregates hold at most 30 counters per column."""
    st = stats_of(table)
    cells, edges = [], []
    for c in st.numeric[:columns]:
        m = st.moments[c.name]
        if not m["n"] or m["min"] is None:
            continue
        bins = bin_count(m["n"])
        width = (m["max"] - m["min"]) / bins
        x = col(c.name).cast("double")
        slot = F.least(F.floor((x - m["min"]) / width), F.lit(bins - 1)) if width else F.lit(0)
        slot = F.when(x.isNotNull(), slot)
        cells.append(F.struct(F.lit(c.name).alias("column"), slot.cast("int").alias("bin")))
        edges.append({"column": c.name, "low": m["min"], "width": width})
    if not cells:
        return small_frame(st.spark, [], "column string, bin int, lower double, upper double, count bigint")
    counted = (
        st.df.select(F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("count"))
    )
    edge = F.broadcast(small_frame(st.spark, edges, "column string, low double, width double"))
    return counted.join(edge, "column").select(
        "column", "bin",
        round_stat(F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
        round_stat(F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        "count",
    )


def box_stats(table: DataFrame | TableStats, columns: int = BOX_COLUMNS) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and outliers."""
    st = stats_of(table)
    names = [c.name for c in st.numeric[:columns]]
    return st.fence_frame().where(F.col("column").isin(names) & (F.col("n") > 0)).select(
        "column",
        *[round_stat(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
        round_stat(F.col("in_min")).alias("whisker_low"), round_stat(F.col("in_max")).alias("whisker_high"),
        "outliers",
    )


def top_correlated_pair(table: DataFrame | TableStats) -> DataFrame:
    """The pair with the largest |r|; undefined counts as 0, the first wins ties."""
    size = F.abs(F.coalesce("r", F.lit(0.0)))
    return stats_of(table).pair_frame().orderBy(size.desc(), "i", "j").limit(1).select(
        "col1", "col2", F.round("r", 4).alias("r")
    )


def scatter_pair(table: DataFrame | TableStats, order_by: list[str], limit: int = SCATTER_POINTS) -> DataFrame:
    """Points of the most correlated pair: first rows that hold both values."""
    st = stats_of(table)
    pair = top_correlated_pair(st).first()
    if pair is None:
        return small_frame(st.spark, [], "x double, y double")
    x, y = col(pair["col1"]), col(pair["col2"])
    return (
        st.df.where(x.isNotNull() & y.isNotNull())
        .orderBy(*[col(c) for c in order_by])
        .limit(limit)
        .select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    )


def missing_bar(table: DataFrame | TableStats) -> DataFrame:
    """Missing counts of the columns that have any."""
    return stats_of(table).missing_frame().where("missing > 0").select("column", "missing")


def category_bars(table: DataFrame | TableStats, columns: int = BAR_COLUMNS, k: int = BAR_VALUES) -> DataFrame:
    """The commonest values of the first categorical columns."""
    st = stats_of(table)
    return value_counts.top_k(st.value_counts(st.categorical[:columns]), k).select(
        "column", "rank", F.col("s").alias("value"), F.col("cnt").alias("count")
    )
