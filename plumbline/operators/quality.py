"""Quality score of a table and suggestions for cleaning it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import one_decimal, percent, round_stat
from plumbline.plans.stats import TableStats, stats_of

# Weight of each dimension in the overall score.
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "outlier_score": 0.25, "validity": 0.15}


def missing_by_column(table: DataFrame | TableStats) -> DataFrame:
    """Missing count and percent of every column."""
    return stats_of(table).missing_frame().select(
        "column", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct")
    )


def duplicate_count(table: DataFrame | TableStats) -> DataFrame:
    """Duplicate rows and the share of rows that are unique."""
    st = stats_of(table)
    frame = small_frame(
        st.spark, [{"rows": st.counts["rows"], "duplicates": st.duplicates}], "rows bigint, duplicates bigint"
    )
    return frame.select("rows", "duplicates", _share_left(F.col("duplicates"), F.col("rows")).alias("uniqueness"))


def iqr_outliers(table: DataFrame | TableStats) -> DataFrame:
    """Values outside the IQR fences per numeric column; 0 for columns with
    fewer than four values or equal quartiles."""
    return stats_of(table).fence_frame().select(
        "column", round_stat(F.col("q1")).alias("q1"), round_stat(F.col("q3")).alias("q3"),
        F.col("n").alias("non_null"), F.col("guarded_outliers").alias("outliers"),
    )


def validity(table: DataFrame | TableStats) -> DataFrame:
    """Text columns most of whose values read as numbers; each costs half an issue."""
    st = stats_of(table)
    rows = [
        {"pos": c.pos, "column": c.name, "hits": st.numeric_text[c.name], "n": st.counts["non_null"][c.name]}
        for c in st.columns
        if c.is_string
    ]
    frame = small_frame(st.spark, rows, "pos int, column string, n bigint, hits bigint")
    share = F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double"))
    return frame.select(
        "column",
        F.round(share, 4).alias("numeric_share"),
        F.when(share > 0.5, 0.5).otherwise(0.0).alias("issue"),
    )


def _share_left(part: Column, whole: Column) -> Column:
    """Percent of ``whole`` that is not ``part``; 100 when there is nothing."""
    share = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return F.round((1 - share) * 100, 2)


def quality_score(table: DataFrame | TableStats) -> DataFrame:
    """One row: the four dimensions, the weighted score and the totals."""
    st = stats_of(table)
    numeric_text, counts = st.numeric_text, st.counts
    st.together(lambda: st.fences, lambda: st.duplicates)
    outliers = st.outlier_counts()
    issues = 0.5 * sum(
        1 for c, hits in numeric_text.items() if counts["non_null"][c] and hits / counts["non_null"][c] > 0.5
    )
    frame = small_frame(
        st.spark,
        [{
            "rows": counts["rows"], "columns": len(st.columns),
            "missing": sum(counts["rows"] - n for n in counts["non_null"].values()),
            "duplicates": st.duplicates, "outliers": sum(outliers.values()),
            "numeric_cells": sum(counts["non_null"][c.name] for c in st.numeric), "issues": issues,
        }],
        "rows bigint, columns bigint, missing bigint, duplicates bigint, outliers bigint, numeric_cells bigint, issues double",
    )
    scored = frame.select(
        "*",
        _share_left(F.col("missing"), F.col("rows") * F.col("columns")).alias("completeness"),
        _share_left(F.col("duplicates"), F.col("rows")).alias("uniqueness"),
        _share_left(F.col("outliers"), F.greatest(F.col("numeric_cells"), F.lit(1))).alias("outlier_score"),
        F.greatest(F.lit(0.0), _share_left(F.col("issues"), F.col("columns"))).alias("validity"),
    )
    overall = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return scored.select(
        F.round(overall, 2).alias("overall_score"), *WEIGHTS, "rows", "columns", "missing", "duplicates", "outliers"
    )


def grade(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Fair").otherwise("Poor")


def quality_grade(table: DataFrame | TableStats) -> DataFrame:
    """Overall score and its grade."""
    return quality_score(table).select("overall_score", grade(F.col("overall_score")).alias("grade"))


def column_stats_numeric(table: DataFrame | TableStats) -> DataFrame:
    """Summary statistics of every numeric column."""
    st = stats_of(table)
    st.together(lambda: st.moments, lambda: st.fences, lambda: st.distinct(st.numeric))
    moments = st.numeric_frame()
    fences = st.fence_frame().select("pos", "q1", "median", "q3", "guarded_outliers")
    distinct = _distinct_frame(st)
    return moments.join(fences, "pos").join(distinct, "pos").select(
        "column", "dtype", (F.col("rows") - F.col("n")).alias("missing_count"),
        percent(F.col("rows") - F.col("n"), F.col("rows")).alias("missing_pct"),
        F.col("distinct").alias("unique_count"),
        *[round_stat(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")],
        round_stat(F.col("q1")).alias("q25"), round_stat(F.col("median")).alias("median"),
        round_stat(F.col("q3")).alias("q75"),
        round_stat(F.col("skewness")).alias("skewness"), round_stat(F.col("kurtosis")).alias("kurtosis"),
        F.col("guarded_outliers").alias("outlier_count"),
    )


def _distinct_frame(st: TableStats) -> DataFrame:
    distinct = st.distinct(st.numeric)
    rows = [{"pos": c.pos, "distinct": distinct[c.name]} for c in st.numeric]
    return small_frame(st.spark, rows, "pos int, distinct bigint")


def column_stats_categorical(table: DataFrame | TableStats) -> DataFrame:
    """Missing, distinct and top value of every non-numeric column."""
    st = stats_of(table)
    missing = st.missing_frame().select("pos", "dtype", "missing", "rows")
    return st.summary_frame(st.categorical).drop("rows").join(missing, "pos").select(
        "column", "dtype", F.col("missing").alias("missing_count"),
        percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        F.col("distinct").alias("unique_count"), "top_value",
    )


# -- suggestions ----------------------------------------------------------

SUGGESTION = "type string, column string, severity string, strategy string, description string"


def _missing_severity(pct: Column) -> Column:
    return F.when(pct > 30, "high").when(pct > 10, "medium").otherwise("low")


def fill_strategy(st: TableStats, name: str) -> str:
    """Mode for text; for numbers the median when strongly skewed, else the mean."""
    moments = st.moments.get(name)
    if moments is None:
        return "mode"
    skew = moments["skewness"]
    return "median" if skew is not None and abs(skew) > 1 else "mean"


def suggest_missing(table: DataFrame | TableStats) -> DataFrame:
    """How to fill each column that has gaps."""
    st = stats_of(table)
    st.moments  # one pass gives both counts and shape
    rows = [{"pos": c.pos, "strategy": fill_strategy(st, c.name)} for c in st.columns]
    strategies = small_frame(st.spark, rows, "pos int, strategy string")
    pct = F.col("missing") / F.col("rows") * 100
    return st.missing_frame().where("missing > 0").join(strategies, "pos").select(
        F.lit("missing_values").alias("type"), "column", _missing_severity(pct).alias("severity"), "strategy",
        F.concat(one_decimal(pct), F.lit("% of '"), F.col("column"), F.lit("' is missing")).alias("description"),
    )


def suggest_duplicates(table: DataFrame | TableStats) -> DataFrame:
    """Drop duplicate rows, when there are any."""
    return duplicate_count(table).where("duplicates > 0").select(
        F.lit("duplicates").alias("type"), F.lit(None).cast("string").alias("column"),
        F.lit("medium").alias("severity"), F.lit("drop_duplicates").alias("strategy"),
        F.concat(
            F.col("duplicates"), F.lit(" duplicate rows ("),
            one_decimal(F.col("duplicates") / F.col("rows") * 100), F.lit("%)"),
        ).alias("description"),
    )


def suggest_outliers(table: DataFrame | TableStats) -> DataFrame:
    """Clip columns where more than 1% of the values are outliers."""
    pct = F.col("guarded_outliers") / F.col("n") * 100
    return stats_of(table).fence_frame().where((F.col("n") > 0) & (pct > 1)).select(
        F.lit("outliers").alias("type"), "column",
        F.when(pct > 10, "high").otherwise("medium").alias("severity"), F.lit("iqr_clip").alias("strategy"),
        F.concat(F.col("guarded_outliers"), F.lit(" outliers in '"), F.col("column"), F.lit("' ("), one_decimal(pct), F.lit("%)"))
        .alias("description"),
    )


def cleaning_suggestions(table: DataFrame | TableStats) -> DataFrame:
    """All suggestions, in the order missing, duplicates, outliers."""
    st = stats_of(table)
    st.together(lambda: st.moments, lambda: st.fences, lambda: st.duplicates)
    return suggest_missing(st).unionByName(suggest_duplicates(st)).unionByName(suggest_outliers(st))


def attention_columns(table: DataFrame | TableStats) -> DataFrame:
    """Columns that want a look, one row per reason."""
    st = stats_of(table)
    st.together(lambda: st.moments, lambda: st.fences)
    pct = percent(F.col("missing"), F.col("rows"))
    missing = st.missing_frame().select("column", F.lit("missing").alias("reason"), pct.alias("value"))
    reasons = [
        missing.where("value > 0"),
        missing.withColumn("reason", F.lit("mostly_missing")).where("value > 10"),
        st.fence_frame()
        .select("column", F.lit("outliers").alias("reason"), F.col("guarded_outliers").cast("double").alias("value"))
        .where("value > 0"),
        st.numeric_frame()
        .select("column", F.lit("skewed").alias("reason"), round_stat(F.col("skewness")).alias("value"))
        .where("abs(value) > 2"),
    ]
    result = reasons[0]
    for frame in reasons[1:]:
        result = result.unionByName(frame)
    return result
