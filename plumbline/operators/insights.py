"""Rules that turn statistics into findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import one_decimal
from plumbline.plans.stats import TableStats, stats_of

REPORT_ROWS = 18


def _finding(kind: str, severity: Column, value: Column, title: Column, description: Column, column: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("type"), severity.alias("severity"),
        (F.col("column") if column is None else column).alias("column"),
        value.cast("double").alias("value"), title.alias("title"), description.alias("description"), "pos",
    ]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def insight_skewness(table: DataFrame | TableStats) -> DataFrame:
    """Columns with a long tail: |skewness| above 1."""
    return _skewness(stats_of(table)).drop("pos")


def _skewness(st: TableStats) -> DataFrame:
    size = F.abs("skewness")
    side = F.when(F.col("skewness") > 0, "right").otherwise("left")
    return st.numeric_frame().where((F.col("n") >= 5) & (size > 1)).select(
        *_finding(
            "skewness", F.when(size > 3, "high").when(size > 2, "medium").otherwise("low"), F.round("skewness", 4),
            _text(F.when(size > 2, "High").otherwise("Moderate"), " skew: ", F.col("column")),
            _text("Long ", side, " tail; a log or root transform may help a model"),
        )
    )


def insight_correlation(table: DataFrame | TableStats) -> DataFrame:
    """Pairs of columns with |r| above 0.8."""
    return _correlation(stats_of(table)).drop("pos")


def _correlation(st: TableStats) -> DataFrame:
    size = F.abs("r")
    sign = F.when(F.col("r") > 0, "positive").otherwise("negative")
    pair = _text(F.col("col1"), " & ", F.col("col2"))
    return st.pair_frame().withColumn("pos", F.col("i").cast("bigint") * len(st.numeric) + F.col("j")).where(size > 0.8).select(
        *_finding(
            "correlation", F.when(size > 0.9, "high").otherwise("medium"), F.round("r", 4),
            _text("Strong correlation: ", pair), _text("Strong ", sign, " correlation; the pair is largely redundant"), pair,
        )
    )


def _imbalance(st: TableStats) -> DataFrame:
    share = F.try_divide(F.col("top_freq").cast("double"), F.col("non_null").cast("double"))
    return st.summary_frame(st.categorical).where(F.col("distinct").between(2, 20) & (share > 0.8)).select(
        *_finding(
            "imbalance", F.lit("high"), F.round(share * 100, 2), _text("Class imbalance: ", F.col("column")),
            _text("'", F.col("top_value"), "' holds ", one_decimal(share * 100), "% of the values; resample before training"),
        )
    )


def insight_imbalance(table: DataFrame | TableStats) -> DataFrame:
    """Categories with 2 to 20 values, one of which holds over 80%."""
    return _imbalance(stats_of(table)).drop("pos")


def insight_low_variance(table: DataFrame | TableStats) -> DataFrame:
    """Numeric columns that hardly vary."""
    return _low_variance(stats_of(table)).drop("pos")


def _low_variance(st: TableStats) -> DataFrame:
    cv = F.coalesce(F.try_divide(F.col("std"), F.abs("mean")), F.lit(0.0))
    return st.numeric_frame().where((F.col("n") >= 5) & (cv < 0.01) & (F.col("std") < 0.001)).select(
        *_finding(
            "low_variance", F.lit("low"), F.round("std", 6), _text("Near-constant: ", F.col("column")),
            _text("The values hardly vary, so they say little to a model"),
        )
    )


def _cardinality(st: TableStats) -> DataFrame:
    share = F.col("distinct") / F.col("rows")
    return st.summary_frame(st.categorical).where((F.col("rows") > 50) & (share > 0.5)).select(
        *_finding(
            "high_cardinality", F.lit("medium"), F.col("distinct"), _text("Many values: ", F.col("column")),
            _text(F.col("distinct"), " distinct values (", one_decimal(share * 100), "% of rows); target or hash encoding suits it"),
        )
    )


def insight_cardinality(table: DataFrame | TableStats) -> DataFrame:
    """Categories with more distinct values than half the rows."""
    return _cardinality(stats_of(table)).drop("pos")


def _constant(st: TableStats) -> DataFrame:
    """Numeric columns are constant when min = max; no values are shuffled."""
    same = F.when(F.col("n") == 0, 0).when(F.col("min") == F.col("max"), 1).cast("bigint")
    numeric = st.numeric_frame().select("pos", "column", same.alias("distinct"))
    text = st.summary_frame(st.categorical).select("pos", "column", "distinct")
    return numeric.unionByName(text).where("distinct <= 1").select(
        *_finding(
            "constant_column", F.lit("medium"), F.col("distinct"), _text("Constant: ", F.col("column")),
            _text(F.col("distinct"), " distinct value(s); drop the column before training"),
        )
    )


def insight_constant(table: DataFrame | TableStats) -> DataFrame:
    """Columns with at most one distinct value; an all-null column has none."""
    return _constant(stats_of(table)).drop("pos")


def insight_summary(table: DataFrame | TableStats) -> DataFrame:
    """One row that describes the table."""
    return _summary(stats_of(table)).drop("pos")


def _summary(st: TableStats) -> DataFrame:
    rows = st.counts["rows"]
    frame = small_frame(
        st.spark,
        [{"rows": rows, "cols": len(st.columns), "numeric": len(st.numeric), "categorical": len(st.categorical),
          "missing": sum(rows - n for n in st.counts["non_null"].values()), "pos": 0}],
        "rows bigint, cols bigint, numeric bigint, categorical bigint, missing bigint, pos int",
    )
    return frame.select(
        *_finding(
            "summary", F.lit("info"), F.lit(None), _text("Table overview"),
            _text(
                F.format_number("rows", 0), " rows, ", F.col("cols"), " columns (", F.col("numeric"), " numeric, ",
                F.col("categorical"), " categorical), ", F.col("missing"), " missing cells",
            ),
            F.lit(None).cast("string"),
        )
    )


RULES = (_skewness, _correlation, _imbalance, _low_variance, _cardinality, _constant, _summary)


def _numbered(st: TableStats) -> DataFrame:
    st.together(lambda: st.correlations, lambda: st.value_summary(st.categorical))
    frames = [rule(st).withColumn("rule_no", F.lit(i)) for i, rule in enumerate(RULES, 1)]
    return reduce(DataFrame.unionByName, frames)


def insights_all(table: DataFrame | TableStats) -> DataFrame:
    """Every finding, numbered by rule; the rules share one set of passes."""
    return _numbered(stats_of(table)).drop("pos")


def insights_report(table: DataFrame | TableStats, limit: int = REPORT_ROWS) -> DataFrame:
    """The first findings in rule order, without the summary."""
    ordered = _numbered(stats_of(table)).where("type <> 'summary'").orderBy("rule_no", "pos").limit(limit)
    return ordered.select("rule_no", "type", "severity", "column", "value", "title", "description")
