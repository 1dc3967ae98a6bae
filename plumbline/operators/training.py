"""Preparing a table for training, splitting it, and scoring predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import CATEGORICAL, NUMERIC, ColumnInfo, col, describe_columns, hash32, nan_to_null
from plumbline.functions.frames import materialise, small_frame
from plumbline.plans import codes as codes_plan
from plumbline.plans.codes import apply_codes, number_values, text_codes
from plumbline.plans.stats import TableStats

CLASSIFICATION = "classification"
REGRESSION = "regression"
NULL_TEXT = "nan"
MIN_ROWS = 10
MAX_MISSING = 0.5
SPLIT_SLOTS = 10_000


def _target(df: DataFrame, target: str) -> ColumnInfo:
    for c in describe_columns(df):
        if c.name == target:
            return c
    raise ValueError(f"target column {target!r} not found; columns: {df.columns}")


def few_values(df: DataFrame, target: str, limit: int) -> DataFrame:
    """``value``: up to ``limit`` distinct values from every task, which reads no further once it has met so many."""
    rows = nan_to_null(df.select(col(target).alias("value"))).where("value IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = set(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            seen.update(batch.column(0).unique().to_pylist())
            if len(seen) >= limit:
                break
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)[:limit], kind)], ["value"])

    return rows.mapInArrow(run, rows.schema)


def _distinct_up_to(df: DataFrame, target: str, limit: int) -> int:
    """Number of distinct values, counted no further than ``limit``; only a few values of each task are shuffled."""
    return few_values(df, target, limit).distinct().limit(limit).count()


def task_single(df: DataFrame, target: str) -> str:
    """Task of the single-model path: text, integers with under 15 values and
    anything with under 10 values are classes."""
    info = _target(df, target)
    if info.role == CATEGORICAL and info.is_string:
        return CLASSIFICATION
    few = 15 if info.is_integral else 10
    return CLASSIFICATION if _distinct_up_to(df, target, few) < few else REGRESSION


def task_automl(df: DataFrame, target: str) -> str:
    """Task of the leaderboard path: text, or under 15 values."""
    info = _target(df, target)
    if info.is_string or _distinct_up_to(df, target, 15) < 15:
        return CLASSIFICATION
    return REGRESSION


def task_frame(df: DataFrame, targets: list[str], rule=task_single) -> DataFrame:
    """Detected task of several targets."""
    rows = [{"column": t, "task": rule(df, t)} for t in targets]
    return small_frame(df.sparkSession, rows, "column string, task string")


def min_rows_guard(df: DataFrame, least: int = MIN_ROWS) -> bool:
    """Whether there are enough rows to train on; reads no more than needed."""
    return df.limit(least).count() >= least


# -- features -------------------------------------------------------------


def keep_columns(df: DataFrame, target: str, key: list[str] = ()) -> DataFrame:
    """Per column, the null share, whether it is constant, and whether it stays.

    Constant means min = max, so no distinct values are shuffled.
    """
    _target(df, target)
    clean = nan_to_null(df)
    infos = [c for c in describe_columns(df) if c.name not in key and c.role in (NUMERIC, CATEGORICAL)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in infos:
        aggs += [F.count(col(c.name)).alias(f"n{c.pos}"), (F.min(col(c.name)) < F.max(col(c.name))).alias(f"v{c.pos}")]
    row = clean.agg(*aggs).first()
    rows = [
        {"column": c.name, "rows": row["rows"], "n": row[f"n{c.pos}"], "varies": bool(row[f"v{c.pos}"]), "is_target": c.name == target}
        for c in infos
    ]
    frame = small_frame(df.sparkSession, rows, "column string, rows bigint, n bigint, varies boolean, is_target boolean")
    share = F.coalesce(1 - F.try_divide(F.col("n").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    dense = share < MAX_MISSING
    return frame.select(
        "column", F.round(share, 4).alias("null_share"), (~F.col("varies")).alias("is_constant"),
        (dense & (F.col("varies") | F.col("is_target"))).alias("keep"),
    )


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace text by its rank in sorted order; missing is a category too."""
    result = df
    for c in columns:
        codes, small = text_codes(df, c, NULL_TEXT)
        result = apply_codes(result, c, codes, small, c, NULL_TEXT)
    return result


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill numeric columns with their exact median."""
    st = TableStats(df)
    medians = st.quantiles([0.5], [c for c in columns if c not in st.complete])
    return st.df.select(
        *[
            F.coalesce(col(c).cast("double"), F.lit(medians[c][0])).alias(c) if c in medians else col(c)
            for c in df.columns
        ]
    )


@dataclass
class Preparation:
    """What turns raw rows into features: medians and text codes, as small frames.

    ``fills`` (column, value) holds the median of each numeric feature, ``codes``
    (column, value, code) the code of each text value seen. Unseen text gets a
    code after all others.
    """

    names: list[str]
    text: list[str]
    fills: DataFrame
    codes: DataFrame

    def apply(self, raw: DataFrame, key: list[str]) -> DataFrame:
        """Key columns and one double per feature of other rows with the same columns."""
        fills = {r["column"]: r["value"] for r in self.fills.collect()}
        rows = nan_to_null(raw.select(*[col(k) for k in key], *[col(c) for c in self.names]))
        sizes = {r["column"]: r["n"] for r in self.codes.groupBy("column").agg((F.max("code") + 1).alias("n")).collect()}
        for c in self.text:
            mine = self.codes.where(F.col("column") == c).select(F.col("value").alias("code_value"), F.col("code").alias("code_number"))
            met = rows.withColumn("code_key", F.coalesce(col(c).cast("string"), F.lit(NULL_TEXT))).join(mine, F.col("code_key") == F.col("code_value"), "left")
            code = F.coalesce(F.col("code_number"), F.lit(sizes.get(c, 0)))
            rows = met.select(*[code.alias(c) if c == n else col(n) for n in rows.columns])
        return rows.select(
            *[col(k) for k in key],
            *[F.coalesce(col(c).cast("double"), F.lit(fills.get(c) or 0.0)).alias(c) for c in self.names],
        )


@dataclass
class Features:
    """Prepared rows: key columns, one double per feature, and ``label``."""

    df: DataFrame
    key: list[str]
    names: list[str]
    target: str
    task: str
    classes: Sequence[str] | None = None
    sizes: dict[str, int] = field(default_factory=dict)
    preparation: Preparation | None = None


class Classes(Sequence):
    """Names of the classes in the order of their numbers; they come to the driver when a name is asked for, not before."""

    def __init__(self, codes: DataFrame, size: int):
        self.codes, self.size, self._names = codes, size, None

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if self._names is None:
            self._names = [str(r["value"]) for r in self.codes.orderBy("code").select("value").collect()]
        return self._names[at]

    def __eq__(self, other) -> bool:
        return list(self) == list(other)


def prepare_target(df: DataFrame, target: str, task: str, source: DataFrame | None = None) -> tuple[DataFrame, Classes | None]:
    """Rows with a target, and ``label``: the class number, or the value itself.

    Numbers follow the order of the values. Many values are numbered in range
    buckets and joined by shuffle; the driver learns how many there are. ``source``
    is a table with the same target values that is cheaper to read.
    """
    clean = nan_to_null(df).where(col(target).isNotNull())
    if task == REGRESSION:
        return clean.withColumn("label", col(target).cast("double")), None
    values = nan_to_null((df if source is None else source).select(col(target).alias("value")))
    codes, small, size = number_values(values, codes_plan.CODE_LIMIT)
    codes = materialise(codes, "classes")
    lookup = codes.select(F.col("value").alias("class_value"), F.col("code").cast("double").alias("class_label"))
    joined = clean.join(F.broadcast(lookup) if small else lookup, col(target) == F.col("class_value"))
    # the number of classes travels with the column: MLlib would look for at most 100 by itself
    about = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": max(2, size)}}
    return joined.select(*[col(c) for c in clean.columns], F.col("class_label").alias("label", metadata=about)), Classes(codes, size)


def prepare_features(df: DataFrame, target: str, key: list[str], task: str = "auto", detect=task_automl) -> Features:
    """Drop sparse and constant columns, encode text, fill gaps.

    ``key`` identifies a row and is not a feature. Statistics come from all
    rows; rows without a target are then left out.
    """
    if task == "auto":
        task = detect(df, target)
    kept = {r["column"] for r in keep_columns(df, target, key).where("keep").collect()}
    if target not in kept:
        raise ValueError(f"target column {target!r} is mostly missing")
    infos = [c for c in describe_columns(df) if c.name in kept and c.name != target]
    if not infos:
        raise ValueError("no usable feature column")
    numeric = [c.name for c in infos if c.role == NUMERIC]
    flags = [c.name for c in infos if c.dtype == "boolean"]
    text = [c.name for c in infos if c.role == CATEGORICAL and c.name not in flags]
    base = df.select(*[col(k) for k in key], *[col(c.name) for c in infos], col(target).alias("target_"))
    st, codes = TableStats(base.select(*[col(c) for c in numeric])) if numeric else None, {c: text_codes(base, c, NULL_TEXT) for c in text}
    medians = st.quantiles([0.5], numeric) if numeric else {}
    encoded = base
    for c, (table, small) in codes.items():
        encoded = apply_codes(encoded, c, table, small, c, NULL_TEXT)
    encoded = nan_to_null(encoded).select(*[F.coalesce(col(c).cast("double"), F.lit(medians[c][0])).alias(c) if c in medians else col(c) for c in encoded.columns])
    spark = df.sparkSession
    fills = small_frame(spark, [{"column": c, "value": medians[c][0]} for c in numeric], "column string, value double")
    coded = [table.select(F.lit(c).alias("column"), "value", F.col("code").cast("bigint").alias("code")) for c, (table, _) in codes.items()]
    coded = reduce(DataFrame.unionByName, coded, small_frame(spark, [], "column string, value string, code bigint"))
    labelled, classes = prepare_target(encoded, "target_", task, base)
    names = [c.name for c in infos]
    ready = labelled.select(
        *[col(k) for k in key], *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], "label"
    )
    if not min_rows_guard(ready):
        raise ValueError(f"not enough rows to train on; at least {MIN_ROWS} are needed")
    return Features(ready, list(key), names, target, task, classes, preparation=Preparation(names, text, fills, coded))


def test_flag(key: list[str], test_size: float) -> Column:
    """Whether a row falls in the test share, by a portable hash of its key."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in key])
    return (hash32(text) % SPLIT_SLOTS) < F.lit(round(test_size * SPLIT_SLOTS))


def hash_split(df: DataFrame, key: list[str], test_size: float = 0.2) -> DataFrame:
    """The table with an ``is_test`` column; the same rows every time."""
    return df.withColumn("is_test", test_flag(key, test_size))


# -- metrics --------------------------------------------------------------


def _confusion(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    return predictions.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def per_class(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Unrounded precision, recall, F1 and support of every class seen."""
    counts = _confusion(predictions, label, prediction)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("hits")),
            )
        )
    )
    total = sides.groupBy("class").agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "predicted", "hits")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hits", "predicted"), zero)
    recall = F.coalesce(F.try_divide("hits", "support"), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero)
    return total.select(
        F.col("class").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "hits",
    )


def metrics_classification(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1."""
    return per_class(predictions, label, prediction).agg(
        F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("f1_score"),
    )


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, the accuracy, and both averages."""
    classes = per_class(predictions, label, prediction)
    names = ("precision", "recall", "f1")
    macro = classes.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")
    )
    share = F.sum("hits") / F.sum("support")
    accuracy = classes.agg(*[share.alias(c) for c in names], F.sum("support").alias("support"))
    rows = (
        classes.select("class", *names, "support")
        .unionByName(accuracy.select(F.lit("accuracy").alias("class"), "*"))
        .unionByName(macro.select(F.lit("macro avg").alias("class"), "*"))
        .unionByName(weighted.select(F.lit("weighted avg").alias("class"), "*"))
    )
    return rows.select("class", *[F.round(c, 4).alias(c) for c in names], F.col("support").cast("bigint").alias("support"))


def metrics_regression(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    y, error = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    sums = predictions.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("spread"))
    return sums.select(
        F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"),
        F.round(1 - F.try_divide("mse", "spread"), 4).alias("r2_score"),
    )
