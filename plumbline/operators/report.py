"""One long report of everything known about a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import small_frame
from plumbline.operators.anomaly import anomaly_summary, flagged_keys, iforest_summary, iqr_column_summary
from plumbline.operators.insights import insights_all
from plumbline.operators.leaderboard import Trained, report
from plumbline.operators.quality import column_stats_categorical, column_stats_numeric, missing_by_column, quality_score
from plumbline.operators.training import CLASSIFICATION
from plumbline.plans.stats import TableStats, stats_of

SCHEMA = "section string, subject string, metric string, value double, text string"
NUMERIC_STATS = ["mean", "std", "min", "max", "q25", "median", "q75", "skewness", "kurtosis", "outlier_count", "missing_count", "unique_count"]
TEXT_STATS = ["missing_count", "unique_count"]
METRICS = ["rank", "score", "accuracy", "f1_score", "rmse", "mae", "r2_score"]


def _melt(frame: DataFrame, section: str, subject: str | Column | None, metrics: list[str], texts: list[str] = ()) -> DataFrame:
    """(section, subject, metric, value, text) of the named columns."""
    none = F.lit(None).cast("string")
    cells = [F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value"), none.alias("text")) for m in metrics]
    cells += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"), col(m).cast("string").alias("text")) for m in texts]
    who = none if subject is None else col(subject) if isinstance(subject, str) else subject
    return frame.select(F.lit(section).alias("section"), who.cast("string").alias("subject"), F.inline(F.array(*cells)))


def report_long(
    table: DataFrame | TableStats, cleaned: DataFrame | None = None, trained: Trained | None = None, scores: DataFrame | None = None,
    key: list[str] = (), with_anomalies: bool = True,
) -> DataFrame:
    """Shape, quality, columns, totals, insights, and whatever else has been computed.

    ``trained`` adds a run's candidates, its best model's results and the
    importances of its features; ``scores`` those of the isolation forest, with
    the keys of the first flagged rows. Numbers are in ``value``, words in ``text``.
    """
    st = stats_of(table)
    st.numeric_text
    st.together(lambda: st.correlations, lambda: st.value_summary(st.categorical), lambda: st.fences, lambda: st.duplicates)
    rows = st.counts["rows"]
    shape = small_frame(st.spark, [{"rows": rows, "columns": len(st.columns)}], "rows bigint, columns bigint")
    totals = small_frame(
        st.spark, [{"missing": sum(rows - n for n in st.counts["non_null"].values()), "duplicates": st.duplicates, "outliers": sum(st.outlier_counts().values())}],
        "missing bigint, duplicates bigint, outliers bigint",
    )
    parts = [
        _melt(shape, "original_shape", None, ["rows", "columns"]),
        _melt(quality_score(st), "quality", None, ["overall_score", "completeness", "uniqueness", "outlier_score", "validity"]),
        _melt(totals, "totals", None, ["missing", "duplicates", "outliers"]),
        _melt(missing_by_column(st), "missing", "column", ["missing", "missing_pct"]),
        insights_all(st).select(
            F.lit("insight").alias("section"), F.col("column").alias("subject"), F.col("type").alias("metric"), "value",
            F.concat("severity", F.lit(": "), "title", F.lit(". "), "description").alias("text"),
        ),
    ]
    if st.numeric:
        parts.append(_melt(column_stats_numeric(st), "column", "column", NUMERIC_STATS, ["dtype"]))
    if st.categorical:
        parts.append(_melt(column_stats_categorical(st), "column", "column", TEXT_STATS, ["dtype", "top_value"]))
    if cleaned is not None:
        size = cleaned.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(cleaned.columns)).alias("columns"))
        parts.append(_melt(size, "cleaned_shape", None, ["rows", "columns"]))
    if with_anomalies and st.numeric:
        parts.append(_melt(anomaly_summary(st, key), "anomaly", None, ["total_rows", "iqr_rows", "iqr_pct", "zscore_rows", "zscore_pct"]))
        parts.append(_melt(iqr_column_summary(st), "anomaly_column", "column", ["count", "pct", "lower_bound", "upper_bound", "min_anomaly", "max_anomaly"]))
    if scores is not None:
        parts.append(_melt(iforest_summary(scores), "anomaly", None, ["iforest_rows", "iforest_pct"]))
        first = flagged_keys(scores, list(key)).select(F.concat_ws("|", *[col(k).cast("string") for k in key]).alias("flagged"))
        parts.append(_melt(first, "anomaly_rows", None, [], ["flagged"]))
    if trained is not None:
        parts += _model_parts(trained)
    return reduce(DataFrame.unionByName, parts)


def _model_parts(trained: Trained) -> list[DataFrame]:
    board = trained.leaderboard
    parts = [
        _melt(trained.summary(), "model", None, ["n_models_trained", "n_models_failed", "n_train", "n_test"], ["task", "best_model"]),
        _melt(small_frame(board.sparkSession, [{"feature": n} for n in trained.features.names], "feature string"), "model", None, [], ["feature"]),
        _melt(board, "leaderboard", "model", METRICS, ["status", "error"]),
    ]
    if trained.best is None:
        return parts
    if trained.best.importances:
        parts.append(_melt(trained.best.importance_frame(board.sparkSession), "importance", "feature", ["importance"]))
    found = report(trained)
    if trained.task == CLASSIFICATION:
        parts.append(_melt(found, "class", "class", ["precision", "recall", "f1", "support"]))
    else:
        parts.append(_melt(found, "model", None, ["rmse", "mae", "r2_score"]))
    return parts


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON lines."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
