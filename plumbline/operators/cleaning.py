"""Cleaning: fill or drop missing values, drop duplicates, clip outliers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import CATEGORICAL, NESTED, NUMERIC, ColumnInfo, col, comparable, describe_columns, nan_to_null
from plumbline.functions.frames import materialise, small_frame
from plumbline.operators.quality import fill_strategy
from plumbline.plans.stats import TableStats

LOG_SCHEMA = "step int, column string, action string, value string, affected bigint"


@dataclass
class Cleaned:
    """A cleaned table, the log of what was done, and the row totals."""

    df: DataFrame
    log_rows: list[dict]
    rows_before: int

    @cached_property
    def rows_after(self) -> int:
        return self.df.count()

    def log(self) -> DataFrame:
        return small_frame(self.df.sparkSession, self.log_rows, LOG_SCHEMA)

    def summary(self) -> DataFrame:
        row = {"rows_before": self.rows_before, "rows_after": self.rows_after, "rows_removed": self.rows_before - self.rows_after}
        return small_frame(self.df.sparkSession, [row], "rows_before bigint, rows_after bigint, rows_removed bigint")


def apply_cleaning(
    df: DataFrame,
    handle_missing: str = "auto",
    remove_duplicates: bool = True,
    handle_outliers: bool = True,
    outlier_method: str = "iqr",
    custom_column_strategies: dict[str, str] | None = None,
) -> Cleaned:
    """Missing values, then duplicates, then outliers, each on the result so far.

    ``handle_missing`` is auto, mean, median, mode or drop, and may be set per
    column. ``outlier_method`` is iqr or zscore.
    """
    log: list[dict] = []
    filled, rows_before, rows_now = _fill_missing(df, handle_missing, custom_column_strategies or {}, log)
    clips = handle_outliers and outlier_method in ("iqr", "zscore")
    if remove_duplicates:
        # the count and the fences need several passes; shuffle the rows only once
        filled = materialise(filled.dropDuplicates(comparable(filled)), "deduplicated")
        kept = filled.count()
        if kept < rows_now:
            _note(log, None, "drop_duplicates", None, rows_now - kept)
    if clips:
        filled = _clip(filled, outlier_method, log)
    return Cleaned(filled, log, rows_before)


def _note(log: list[dict], column: str | None, action: str, value, affected: int) -> None:
    text = f"{value:.4f}" if isinstance(value, float) else (None if value is None else str(value))
    log.append({"step": len(log) + 1, "column": column, "action": action, "value": text, "affected": affected})


def _wanted(c: ColumnInfo, overall: str, custom: dict[str, str]) -> str:
    """Strategy that applies to a column's type, or '' to leave it alone."""
    strategy = custom.get(c.name, overall)
    if c.role == NUMERIC:
        return strategy if strategy in ("auto", "mean", "median", "mode", "drop") else ""
    if c.role == CATEGORICAL:
        return {"auto": "mode", "mode": "mode", "drop": "drop"}.get(strategy, "")
    return "drop" if strategy == "drop" and c.role == NESTED else ""


def _fill_missing(df: DataFrame, overall: str, custom: dict[str, str], log: list[dict]):
    """Fill every column in schema order.

    A dropped column hides rows from the statistics of the columns after it.
    So each column is seen through a mask of the rows still alive at its turn,
    and one pass serves all columns whatever the mix of strategies.
    """
    clean = nan_to_null(df)
    columns = describe_columns(df)
    plan = {c.name: _wanted(c, overall, custom) for c in columns}
    alive: Column | None = None
    masked, gaps, standing = [], [], {}
    for c in columns:
        value = col(c.name)
        masked.append(value.alias(c.name) if alive is None else F.when(alive, value).alias(c.name))
        gaps.append(F.count_if(value.isNull() if alive is None else alive & value.isNull()).alias(f"g{c.pos}"))
        if plan[c.name] == "drop":
            alive = value.isNotNull() if alive is None else alive & value.isNotNull()
    row = clean.agg(F.count(F.lit(1)).alias("rows"), *gaps).first()
    gap = {c.name: row[f"g{c.pos}"] for c in columns}

    seen = [c for c in columns if gap[c.name] and plan[c.name] not in ("", "drop")]
    view = TableStats(clean.select(*[m for c, m in zip(columns, masked) if c in seen])) if seen else None
    by_name = {c.name: c for c in view.columns} if view else {}
    chosen = {c.name: fill_strategy(view, c.name) if plan[c.name] == "auto" else plan[c.name] for c in seen}
    medians = view.quantiles([0.5], [n for n, s in chosen.items() if s == "median"]) if view else {}
    modes = view.value_summary([by_name[n] for n, s in chosen.items() if s == "mode"]) if view else {}

    output, rows = [], row["rows"]
    for c in columns:
        strategy, value = chosen.get(c.name, plan[c.name]), col(c.name)
        if not gap[c.name] or not strategy:
            output.append(value)
            continue
        if strategy == "drop":
            rows -= gap[c.name]
            output.append(value)
            _note(log, c.name, "drop_rows", None, gap[c.name])
            continue
        fill = _fill_value(c, strategy, view, medians, modes)
        kind = "double" if strategy in ("mean", "median") else c.dtype
        output.append(value.cast(kind).alias(c.name) if fill is None else F.coalesce(value.cast(kind), F.lit(fill).cast(kind)).alias(c.name))
        _note(log, c.name, f"fill_{strategy}", fill, gap[c.name])
    result = clean if alive is None else clean.where(alive)
    return result.select(*output), row["rows"], rows


def _fill_value(c: ColumnInfo, strategy: str, view: TableStats, medians: dict, modes: dict):
    if strategy == "mean":
        return view.moments[c.name]["mean"]
    if strategy == "median":
        return medians[c.name][0]
    summary = modes[c.name]
    if not summary["distinct"]:
        return 0 if c.role == NUMERIC else ("Unknown" if c.is_string else None)
    return next(summary[f] for f in ("i", "d", "s") if summary[f] is not None)


def _clip(df: DataFrame, method: str, log: list[dict]) -> DataFrame:
    """Clip numeric columns to their fences; every numeric column becomes a
    double, so that the schema does not depend on the data."""
    st = TableStats(df)
    if not st.numeric:
        return df
    bounds = st.iqr_bounds() if method == "iqr" else st.zscore_bounds(least=4)
    hits = _outside(st, bounds, method)
    output = []
    for c in st.columns:
        value = col(c.name)
        if c.role != NUMERIC:
            output.append(value)
            continue
        value = value.cast("double")
        if hits.get(c.name):
            lower, upper = bounds[c.name]
            _note(log, c.name, f"clip_{method}", f"[{lower:.4f}, {upper:.4f}]", hits[c.name])
            value = F.when(value < lower, lower).when(value > upper, upper).otherwise(value)
        output.append(value.alias(c.name))
    return df.select(*output)


def _outside(st: TableStats, bounds: dict[str, tuple[float, float]], method: str) -> dict[str, int]:
    if not bounds:
        return {}
    if method == "iqr":
        return {c: st.fences[c]["outliers"] for c in bounds}
    tests = [
        F.count_if((col(c).cast("double") < lower) | (col(c).cast("double") > upper)).alias(f"o{i}")
        for i, (c, (lower, upper)) in enumerate(bounds.items())
    ]
    row = st.df.agg(*tests).first()
    return {c: row[f"o{i}"] for i, c in enumerate(bounds)}


# -- single steps ---------------------------------------------------------


def _step(df: DataFrame, **options) -> DataFrame:
    off = {"handle_missing": "none", "remove_duplicates": False, "handle_outliers": False}
    return apply_cleaning(df, **{**off, **options}).df


def fill_missing(df: DataFrame, strategy: str = "auto", columns: dict[str, str] | None = None) -> DataFrame:
    """Fill (or drop) missing values only."""
    return _step(df, handle_missing=strategy, custom_column_strategies=columns)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows, by all columns that can be compared; nothing runs until they are read."""
    clean = nan_to_null(df)
    return clean.dropDuplicates(comparable(clean)) if comparable(clean) else clean


def clip_outliers(df: DataFrame, method: str = "iqr") -> DataFrame:
    """Clip numeric columns to their IQR or z-score fences."""
    return _step(df, handle_outliers=True, outlier_method=method)
