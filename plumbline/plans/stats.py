"""Table statistics, each computed once and shared by every operator.

Only bounded facts reach the driver: one number per column, pair or rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import CATEGORICAL, NUMERIC, ColumnInfo, col, comparable, describe_columns, nan_to_null
from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import looks_numeric
from plumbline.plans import correlation, moments, quantiles, value_counts

IQR_FENCE = 1.5


def stats_of(table: "DataFrame | TableStats") -> "TableStats":
    return table if isinstance(table, TableStats) else TableStats(table)


def sample_skewness(g1: float | None, n: int, std: float | None) -> float | None:
    """Bias-corrected skewness from the population one; 0 for a constant."""
    if n < 3:
        return None
    if std == 0:
        return 0.0
    return None if g1 is None else g1 * math.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(g2: float | None, n: int, std: float | None) -> float | None:
    """Bias-corrected excess kurtosis from the population one."""
    if n < 4:
        return None
    if std == 0:
        return 0.0
    return None if g2 is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


class TableStats:
    """Lazily computed, cached statistics of one DataFrame.

    ``approx`` trades exact distinct counts and quantiles for sketches of
    fixed size (HyperLogLog++ and percentile_approx).
    """

    def __init__(self, df: DataFrame, approx: bool = False, exact_limit: int = quantiles.EXACT_LIMIT):
        self.source = df
        self.df = nan_to_null(df)
        self.spark = df.sparkSession
        self.approx = approx
        self.exact_limit = exact_limit
        self.columns: list[ColumnInfo] = describe_columns(df)
        self._quantiles: dict[tuple[str, float], float | None] = {}
        self._sketches: dict[str, list[float]] = {}
        self._summaries: dict[str, dict] = {}
        self._distinct: dict[str, int] = {}

    # -- schema -----------------------------------------------------------

    @property
    def numeric(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.role == NUMERIC]

    @property
    def categorical(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.role == CATEGORICAL]

    @property
    def profiled(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.role in (NUMERIC, CATEGORICAL)]

    def column_frame(self) -> DataFrame:
        """(pos, column, dtype, role) in schema order."""
        rows = [{"pos": c.pos, "column": c.name, "dtype": c.dtype, "role": c.role} for c in self.columns]
        return small_frame(self.spark, rows, "pos int, column string, dtype string, role string")

    def together(self, *passes: Callable[[], object]) -> None:
        """Run independent passes side by side, so that a short job need not
        wait for a long one. Counts, which all of them use, come first."""
        self.counts
        run = inheritable_thread_target(self.spark)(lambda task: task())
        with ThreadPoolExecutor(len(passes)) as pool:
            list(pool.map(run, passes))

    # -- one-pass aggregates ----------------------------------------------

    def _count(self, extra: list[Column]):
        aggs = [F.count(F.lit(1)).alias("rows"), *[F.count(col(c.name)).alias(f"n{c.pos}") for c in self.columns]]
        row = self.df.agg(*aggs, *extra).first()
        return row, {"rows": row["rows"], "non_null": {c.name: row[f"n{c.pos}"] for c in self.columns}}

    @cached_property
    def counts(self) -> dict:
        """Rows, and the non-null count of every column."""
        return self._count([])[1]

    @cached_property
    def numeric_text(self) -> dict[str, int]:
        """Numeric-looking values per text column; the same pass yields ``counts``."""
        text = [c for c in self.columns if c.is_string]
        row, counts = self._count([F.count_if(looks_numeric(col(c.name))).alias(f"text{c.pos}") for c in text])
        self.__dict__.setdefault("counts", counts)
        return {c.name: row[f"text{c.pos}"] for c in text}

    def numeric_long(self, names: list[str]) -> DataFrame:
        """(p, x): the numeric cells with the position of their column in
        ``names``. Grouping by ``p`` keeps the generated code small and the
        final merge of each column in its own task, however wide the table."""
        cells = F.array(*[col(c).cast("double") for c in names])
        return self.df.select(F.posexplode(cells).alias("p", "x")).where("x IS NOT NULL")

    @cached_property
    def moments(self) -> dict[str, dict]:
        """Per numeric column: mean, spread, shape, range and signs."""
        blank = {"n": 0, "mean": None, "std": None, "variance": None, "min": None, "max": None, "g1": None, "g2": None,
                 "zeros": 0, "negatives": 0}
        result = {c.name: dict(blank) for c in self.numeric}
        names = list(result)
        if names:
            for name, facts in moments.moments(self.df, names).items():
                result[name].update(facts)
            # a table known to be too large to sort gets first brackets for its quantiles
            if not self.approx and self.__dict__.get("counts", {"rows": 0})["rows"] > self.exact_limit:
                self.sketches([c for c in names if result[c]["n"]])
        for m in result.values():
            m["std"] = math.sqrt(m["variance"]) if m["variance"] is not None else None
            m["skewness"] = sample_skewness(m["g1"], m["n"], m["std"])
            m["kurtosis"] = sample_kurtosis(m["g2"], m["n"], m["std"])
        return result

    def sketches(self, names: list[str]) -> dict[str, list[float]]:
        """Sketched values of the columns, taken with the moments or else when they are asked for."""
        need = [c for c in names if c not in self._sketches]
        if need:
            for row in self.numeric_long(need).groupBy("p").agg(quantiles.sketch().alias("sketch")).collect():
                self._sketches[need[row["p"]]] = list(row["sketch"])
        return {c: self._sketches[c] for c in names}

    # -- quantiles and fences ---------------------------------------------

    def quantiles(self, probs: list[float], columns: list[str] | None = None) -> dict[str, list[float | None]]:
        names = columns if columns is not None else [c.name for c in self.numeric]
        need = [c for c in names if any((c, p) not in self._quantiles for p in probs)]
        if need:
            sizes = {c: self.counts["non_null"][c] for c in need}
            if self.approx:
                values = {c: [None] * len(probs) for c in need}
                sketch = F.percentile_approx("x", probs, 10000).alias("q")
                for row in self.numeric_long(need).groupBy("p").agg(sketch).collect():
                    values[need[row["p"]]] = list(row["q"])
            else:
                values = quantiles.quantiles(self, sizes, probs, self.exact_limit)
            for c in need:
                self._quantiles.update({(c, p): v for p, v in zip(probs, values[c])})
        return {c: [self._quantiles[(c, p)] for p in probs] for c in names}

    def quartiles(self) -> dict[str, tuple]:
        return {c: tuple(q) for c, q in self.quantiles([0.25, 0.5, 0.75]).items()}

    def iqr_bounds(self, guarded: bool = True) -> dict[str, tuple[float, float]]:
        """Lower and upper IQR fence per numeric column. ``guarded`` leaves out
        columns with fewer than four values or no spread between quartiles."""
        bounds = {}
        for name, (q1, _, q3) in self.quartiles().items():
            if q1 is None or not math.isfinite(q3 - q1):
                continue
            iqr = q3 - q1
            if guarded and (self.counts["non_null"][name] < 4 or iqr == 0):
                continue
            bounds[name] = (q1 - IQR_FENCE * iqr, q3 + IQR_FENCE * iqr)
        return bounds

    def zscore_bounds(self, limit: float = 3.0, least: int = 5) -> dict[str, tuple[float, float]]:
        bounds = {}
        for name, m in self.moments.items():
            if m["n"] >= least and m["std"]:
                bounds[name] = (m["mean"] - limit * m["std"], m["mean"] + limit * m["std"])
        return bounds

    @cached_property
    def fences(self) -> dict[str, dict]:
        """Second pass with literal fences: rows outside, their range, and the
        range of the values inside. Unguarded; callers apply their own guard."""
        bounds = self.iqr_bounds(guarded=False)
        if not bounds:
            return {}
        names = list(bounds)
        x = F.col("x")
        lower, upper = (F.get(F.array(*[F.lit(bounds[c][k]) for c in names]), F.col("p")) for k in (0, 1))
        outside = (x < lower) | (x > upper)
        found = self.numeric_long(names).groupBy("p").agg(
            F.count_if(outside).alias("outliers"),
            F.min(F.when(outside, x)).alias("out_min"), F.max(F.when(outside, x)).alias("out_max"),
            F.min(F.when(~outside, x)).alias("in_min"), F.max(F.when(~outside, x)).alias("in_max"),
        )
        result = {}
        for row in found.collect():
            name = names[row["p"]]
            facts = {k: v for k, v in row.asDict().items() if k != "p"}
            result[name] = {"lower": bounds[name][0], "upper": bounds[name][1], **facts}
        return result

    def outlier_counts(self) -> dict[str, int]:
        """IQR outliers per numeric column, 0 where the guard applies."""
        guarded = self.iqr_bounds()
        if not guarded:
            return {c.name: 0 for c in self.numeric}
        return {c.name: self.fences[c.name]["outliers"] if c.name in guarded else 0 for c in self.numeric}

    # -- values, duplicates, pairs ----------------------------------------

    def value_counts(self, columns: list[ColumnInfo]) -> DataFrame:
        return value_counts.value_counts(self.df, columns)

    def value_summary(self, columns: list[ColumnInfo]) -> dict[str, dict]:
        """Per column: distinct, top value and its count, entropy."""
        need = [c for c in columns if c.name not in self._summaries]
        if need:
            empty = {"distinct": 0, "non_null": 0, "entropy": 0.0, "top_freq": 0, "i": None, "d": None, "s": None}
            self._summaries.update({c.name: dict(empty) for c in need})
            for row in value_counts.summarise(self.value_counts(need)).collect():
                self._summaries[row["column"]] = row.asDict()
        return {c.name: self._summaries[c.name] for c in columns}

    def distinct(self, columns: list[ColumnInfo]) -> dict[str, int]:
        if self.approx:
            row = self.df.agg(*[F.approx_count_distinct(col(c.name)).alias(f"u{c.pos}") for c in columns]).first()
            return {c.name: row[f"u{c.pos}"] for c in columns}
        if all(c.name in self._summaries for c in columns):
            return {c.name: self._summaries[c.name]["distinct"] for c in columns}
        need = [c for c in columns if c.name not in self._distinct]
        if need:
            self._distinct.update({c.name: 0 for c in need})
            self._distinct.update({r["column"]: r["n"] for r in value_counts.distinct_counts(self.df, need).collect()})
        return {c.name: self._distinct[c.name] for c in columns}

    @cached_property
    def duplicates(self) -> int:
        """Rows beyond the first of each group of equal rows.

        Rows are counted by a 128-bit digest of their values and gaps: a row
        costs 16 bytes of shuffle however wide it is, and counts combine in
        every task first, so that a hot row costs one record a task.
        """
        columns = [col(c) for c in comparable(self.df)]
        if not columns:
            return 0
        gaps = [c.isNull() for c in columns]
        digest = [F.xxhash64(*columns, *gaps).alias("h1"), F.xxhash64(F.lit(7), *gaps, *columns).alias("h2")]
        groups = self.df.groupBy(*digest).agg(F.count(F.lit(1)).alias("cnt"))
        return groups.agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0))).first()[0]

    @cached_property
    def correlations(self) -> dict[tuple[str, str], float | None]:
        """Pearson r of every column pair (i < j), pairwise complete."""
        return correlation.correlations(self.df, self.moments, self.complete)

    @cached_property
    def complete(self) -> set[str]:
        """Columns without a missing value."""
        return {c for c, n in self.counts["non_null"].items() if n == self.counts["rows"]}

    # -- frames -----------------------------------------------------------

    def numeric_frame(self) -> DataFrame:
        """One row per numeric column with every moment; unrounded."""
        rows = []
        for c in self.numeric:
            m = self.moments[c.name]
            rows.append({"pos": c.pos, "column": c.name, "dtype": c.dtype, "rows": self.counts["rows"], **m})
        return small_frame(
            self.spark, rows,
            "pos int, column string, dtype string, rows bigint, n bigint, mean double, std double, variance double, "
            "min double, max double, g1 double, g2 double, skewness double, kurtosis double, zeros bigint, negatives bigint",
        )

    def fence_frame(self) -> DataFrame:
        """One row per numeric column: quartiles, fences and both outlier rules."""
        guarded, rows = self.outlier_counts(), []
        for c in self.numeric:
            q1, q2, q3 = self.quartiles()[c.name]
            rows.append({
                "pos": c.pos, "column": c.name, "rows": self.counts["rows"], "n": self.counts["non_null"][c.name],
                "q1": q1, "median": q2, "q3": q3, "guarded_outliers": guarded[c.name], **self.fences.get(c.name, {}),
            })
        return small_frame(
            self.spark, rows,
            "pos int, column string, rows bigint, n bigint, q1 double, median double, q3 double, guarded_outliers bigint, "
            "lower double, upper double, outliers bigint, out_min double, out_max double, in_min double, in_max double",
        )

    def missing_frame(self) -> DataFrame:
        """One row per column: rows, non-null and missing counts."""
        rows = [
            {"pos": c.pos, "column": c.name, "dtype": c.dtype, "role": c.role, "rows": self.counts["rows"],
             "non_null": self.counts["non_null"][c.name],
             "missing": self.counts["rows"] - self.counts["non_null"][c.name]}
            for c in self.columns
        ]
        return small_frame(
            self.spark, rows,
            "pos int, column string, dtype string, role string, rows bigint, non_null bigint, missing bigint",
        )

    def summary_frame(self, columns: list[ColumnInfo]) -> DataFrame:
        """One row per column: distinct values, mode and entropy."""
        summary = self.value_summary(columns)
        rows = [
            {"pos": c.pos, "column": c.name, "rows": self.counts["rows"], **summary[c.name]} for c in columns
        ]
        return small_frame(
            self.spark, rows,
            "pos int, column string, rows bigint, non_null bigint, distinct bigint, top_freq bigint, entropy double, "
            "i bigint, d double, s string",
        ).withColumn("top_value", value_counts.value_text()).drop("i", "d", "s")

    def pair_frame(self) -> DataFrame:
        """One row per numeric column pair, i < j in schema order."""
        place = {c.name: k for k, c in enumerate(self.numeric)}
        rows = [{"i": place[a], "j": place[b], "col1": a, "col2": b, "r": r} for (a, b), r in self.correlations.items()]
        return small_frame(self.spark, rows, "i int, j int, col1 string, col2 string, r double")
