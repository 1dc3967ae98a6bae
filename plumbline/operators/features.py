"""Feature suggestions, and the transforms they prescribe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, hash32, nan_to_null
from plumbline.functions.frames import small_frame
from plumbline.plans import dates
from plumbline.plans.stats import TableStats, stats_of
from plumbline.plans.value_counts import unpivot

BIN_ABOVE = 20
ONE_HOT_LIMIT = 10
TARGET_LIMIT = 50
HASH_SPACE = 1000
DATE_ROWS = 50
DATE_SHARE = 0.8
TARGET_SMOOTHING = 10.0

SUGGESTION = "seq int, type string, column string, priority string, title string, description string, feature string"


def _rule(kind: str, priority: str, title: str, text: str | Column, suffix: str):
    """Columns of a suggestion about one column."""
    text = F.lit(text) if isinstance(text, str) else text
    return [
        F.lit(kind).alias("type"), F.col("column"), F.lit(priority).alias("priority"),
        F.concat(F.lit(title + " "), F.col("column")).alias("title"), text.alias("description"),
        F.concat(F.col("column"), F.lit(suffix)).alias("feature"),
    ]


def _numeric(st: TableStats) -> DataFrame:
    return st.numeric_frame().where("n >= 5").withColumn("size", F.abs("skewness"))


def suggest_log(table: DataFrame | TableStats) -> DataFrame:
    """Strongly skewed positive columns."""
    return _numeric(stats_of(table)).where("size > 2 AND negatives = 0 AND zeros = 0").select(
        *_rule("log_transform", "high", "Log of", F.format_string("skewness %.2f, all values positive", "size"), "_log")
    )


def suggest_sqrt(table: DataFrame | TableStats) -> DataFrame:
    """Skewed columns without negatives."""
    return _numeric(stats_of(table)).where("size > 1 AND negatives = 0").select(
        *_rule("sqrt_transform", "medium", "Square root of", F.format_string("skewness %.2f, no negatives", "size"), "_sqrt")
    )


def suggest_bins(table: DataFrame | TableStats) -> DataFrame:
    """Numeric columns with more than 20 values."""
    st = stats_of(table)
    distinct = st.distinct(st.numeric)
    wide = small_frame(st.spark, [{"column": c, "values": n} for c, n in distinct.items() if n > BIN_ABOVE], "column string, values bigint")
    return _numeric(st).join(wide, "column").select(
        *_rule("binning", "low", "Quartile bins of", F.format_string("%d distinct values", "values"), "_bin")
    )


def suggest_zscore(table: DataFrame | TableStats) -> DataFrame:
    """Every numeric column with at least five values."""
    return _numeric(stats_of(table)).select(
        *_rule("normalize", "medium", "Standardise", "distance-based models need one scale", "_z")
    )


def interaction_pairs(table: DataFrame | TableStats, above: float = 0.5, limit: int = 3, rank_by: str = "order") -> list[tuple[str, str]]:
    """Correlated pairs: the first in column order, or the strongest."""
    st = stats_of(table)
    order = [F.abs("r").desc(), F.col("i"), F.col("j")] if rank_by == "strength" else [F.col("i"), F.col("j")]
    rows = st.pair_frame().where(F.abs("r") > above).orderBy(*order).limit(limit).collect()
    return [(r["col1"], r["col2"]) for r in rows]


def ratio_pairs(table: DataFrame | TableStats) -> list[tuple[str, str]]:
    """The first two numeric columns, each over its right-hand neighbour."""
    names = [c.name for c in stats_of(table).numeric]
    if len(names) < 2:
        return []
    return [(names[i], names[(i + 1) % len(names)]) for i in range(2)]


def _pairs(st: TableStats, pairs: list[tuple[str, str]], kind: str, priority: str, sign: str, texts: list[str], feature: str) -> DataFrame:
    rows = [
        {"type": kind, "column": f"{a}{sign}{b}", "priority": priority, "title": f"{kind.capitalize()} {a}{sign}{b}",
         "description": text, "feature": feature.format(a=a, b=b)}
        for (a, b), text in zip(pairs, texts)
    ]
    return small_frame(st.spark, rows, SUGGESTION.replace("seq int, ", ""))


def suggest_interaction(table: DataFrame | TableStats) -> DataFrame:
    """Products of correlated pairs."""
    st = stats_of(table)
    pairs = interaction_pairs(st)
    return _pairs(st, pairs, "interaction", "medium", " × ", [f"correlation {st.correlations[p]:.2f}" for p in pairs], "{a}_x_{b}")


def suggest_ratio(table: DataFrame | TableStats) -> DataFrame:
    """Ratios of neighbouring numeric columns."""
    st = stats_of(table)
    pairs = ratio_pairs(st)
    return _pairs(st, pairs, "ratio", "low", "/", ["relative size, free of scale"] * len(pairs), "{a}_per_{b}")


def encoding_of(distinct: int) -> tuple[str, str, str]:
    """Encoding kind, priority and feature suffix for a number of categories."""
    if distinct == 2:
        return "binary_encode", "high", "_enc"
    if distinct <= ONE_HOT_LIMIT:
        return "onehot", "high", "_*"
    if distinct <= TARGET_LIMIT:
        return "target_encode", "medium", "_target"
    return "hash_encode", "low", "_hash"


def suggest_encoding(table: DataFrame | TableStats) -> DataFrame:
    """How to encode each categorical column, by its number of values."""
    st = stats_of(table)
    rows = []
    for c, n in st.distinct(st.categorical).items():
        kind, priority, suffix = encoding_of(n)
        rows.append({"type": kind, "column": c, "priority": priority, "title": f"Encode {c}",
                     "description": f"{n} categories", "feature": c + suffix})
    return small_frame(st.spark, rows, SUGGESTION.replace("seq int, ", ""))


def date_columns(table: DataFrame | TableStats, order_by: list[str]) -> list[str]:
    """Categorical columns most of whose first 50 values read as dates."""
    st = stats_of(table)
    if not st.categorical:
        return []
    typed = [c.name for c in st.categorical if c.dtype.startswith(("timestamp", "date"))]
    text = [c for c in st.categorical if c.is_string]
    found = set(typed)
    if text:
        # one pass over all columns; the rank limit drops rows before the shuffle
        names = [f"order_{i}" for i in range(len(order_by))]
        rows = st.df.select(*[col(k).alias(n) for k, n in zip(order_by, names)], *[col(c.name) for c in text])
        order = Window.partitionBy("column").orderBy(*names, "s")
        first = unpivot(rows, text, names).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= DATE_ROWS)
        hits = first.groupBy("column").agg(F.avg(dates.parse(F.col("s")).isNotNull().cast("double")).alias("share"))
        found |= {r["column"] for r in hits.where(F.col("share") > DATE_SHARE).collect()}
    return [c.name for c in st.categorical if c.name in found]


def suggest_datetime(table: DataFrame | TableStats, order_by: list[str]) -> DataFrame:
    """Text columns that hold dates."""
    st = stats_of(table)
    rows = [{"column": c} for c in date_columns(st, order_by)]
    return small_frame(st.spark, rows, "column string").select(
        *_rule("datetime_extract", "high", "Date parts of", "the text reads as dates", "_year/_month/_weekday")
    )


def feature_suggestions(table: DataFrame | TableStats, order_by: list[str]) -> DataFrame:
    """Every suggestion, high priority first."""
    st = stats_of(table)
    frames = [suggest_log(st), suggest_sqrt(st), suggest_bins(st), suggest_zscore(st), suggest_interaction(st),
              suggest_ratio(st), suggest_encoding(st), suggest_datetime(st, order_by)]
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return reduce(DataFrame.unionByName, frames).orderBy(rank, "type", "column")


def suggestion_totals(suggestions: DataFrame) -> DataFrame:
    """Number of suggestions, and of those with high priority."""
    return suggestions.agg(F.count(F.lit(1)).alias("total_suggestions"), F.count_if(F.col("priority") == "high").alias("high_priority"))


def auto_features(suggestions: DataFrame) -> DataFrame:
    """Names of the features that are worth adding unasked."""
    return suggestions.where(F.col("type").isin("log_transform", "interaction")).select(F.col("feature").alias("name"), "type")


def suggestion_filter(suggestions: DataFrame, priority: str | None = None, text: str = "") -> DataFrame:
    """Suggestions of a priority whose title or column contains ``text``."""
    found = suggestions if priority in (None, "all") else suggestions.where(F.col("priority") == priority)
    needle = text.lower()
    return found.where(F.lower("title").contains(needle) | F.lower("column").contains(needle))


# -- transforms: each appends columns to the whole table, or to ``onto`` what was learned from it --


def add_log(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.log1p(col(c).cast("double")).alias(f"{c}_log") for c in columns])


def add_sqrt(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.when(col(c).isNotNull(), F.sqrt(F.greatest(col(c).cast("double"), F.lit(0.0)))).alias(f"{c}_sqrt") for c in columns])


def add_quartile_bin(table: DataFrame | TableStats, columns: list[str], onto: DataFrame | None = None) -> DataFrame:
    """Right-closed quartile bins numbered from 0; equal edges merge. Values of
    ``onto`` beyond the fitted range fall into the outer bins."""
    st = stats_of(table)
    bins = []
    for c, edges in st.quantiles([0.0, 0.25, 0.5, 0.75, 1.0], columns).items():
        inner = sorted({e for e in edges if e is not None})[1:-1]
        x = col(c).cast("double")
        label = reduce(lambda n, e: n + F.when(x > e, 1).otherwise(0), inner, F.lit(0))
        bins.append(F.when(x.isNotNull(), label).alias(f"{c}_bin"))
    return _target(st, onto).select("*", *bins)


def _target(st: TableStats, onto: DataFrame | None) -> DataFrame:
    return st.df if onto is None else nan_to_null(onto)


def add_zscore(table: DataFrame | TableStats, columns: list[str], onto: DataFrame | None = None) -> DataFrame:
    """Distance from the mean in deviations."""
    st = stats_of(table)
    scaled = []
    for c in columns:
        m = st.moments[c]
        x = col(c).cast("double")
        scaled.append((((x - m["mean"]) / m["std"]) if m["std"] else F.lit(None).cast("double")).alias(f"{c}_z"))
    return _target(st, onto).select("*", *scaled)


def add_interaction(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.select("*", *[(col(a).cast("double") * col(b).cast("double")).alias(f"{a}_x_{b}") for a, b in pairs])


def add_ratio(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.select("*", *[F.try_divide(col(a).cast("double"), col(b).cast("double") + 1e-9).alias(f"{a}_per_{b}") for a, b in pairs])


def add_binary(table: DataFrame | TableStats, columns: list[str], onto: DataFrame | None = None) -> DataFrame:
    """1 where the value is the mode, else 0 (missing included)."""
    st = stats_of(table)
    summary = st.value_summary([c for c in st.categorical if c.name in columns])
    flags = [F.coalesce((col(c).cast("string") == summary[c]["s"]).cast("int"), F.lit(0)).alias(f"{c}_enc") for c in columns]
    return _target(st, onto).select("*", *flags)


def add_onehot(table: DataFrame | TableStats, columns: list[str], onto: DataFrame | None = None) -> DataFrame:
    """One 0/1 column per value, in place of the column. Other values of ``onto`` are 0 throughout."""
    st = stats_of(table)
    infos = [c for c in st.categorical if c.name in columns]
    over = [c for c, n in st.distinct(infos).items() if n > ONE_HOT_LIMIT]
    if over:
        raise ValueError(f"too many values to one-hot encode: {over}")
    values = sorted((r["column"], r["s"]) for r in st.value_counts(infos).select("column", "s").collect())
    rows = _target(st, onto)
    kept = [col(c) for c in rows.columns if c not in columns]
    return rows.select(*kept, *[F.coalesce(col(c).cast("string") == v, F.lit(False)).cast("int").alias(f"{c}_{v}") for c, v in values])


def add_target_encoding(
    df: DataFrame, column: str, target: str, smoothing: float = TARGET_SMOOTHING, onto: DataFrame | None = None
) -> DataFrame:
    """Mean target of the category, pulled towards the overall mean; a category
    that was not seen gets the mean itself."""
    y = col(target).cast("double")
    prior = df.agg(F.avg(y)).first()[0]
    groups = df.where(col(column).isNotNull()).groupBy(col(column).alias("category")).agg(
        F.sum(y).alias("total"), F.count(y).alias("n")
    )
    value = (F.coalesce("total", F.lit(0.0)) + smoothing * F.lit(prior)) / (F.coalesce("n", F.lit(0)) + smoothing)
    rows = df if onto is None else onto
    return rows.join(groups, col(column) == F.col("category"), "left").select(
        *[col(c) for c in rows.columns], value.alias(f"{column}_target")
    )


def add_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Stable hash of the text, in 1000 slots; missing values hash as 'nan'."""
    return df.select("*", *[(hash32(F.coalesce(col(c).cast("string"), F.lit("nan"))) % HASH_SPACE).alias(f"{c}_hash") for c in columns])


def add_date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Year, month and weekday (Monday 0) of dates in text; the whole column settles whether a day or a month comes first."""
    parts, turned = [], dates.day_first(df, [c for c in columns if df.schema[c].dataType.simpleString() == "string"])
    for c in columns:
        t = dates.day_of(col(c).cast("string"), c in turned)
        parts += [F.year(t).alias(f"{c}_year"), F.month(t).alias(f"{c}_month"), F.weekday(t).alias(f"{c}_weekday")]
    return df.select("*", *parts)
