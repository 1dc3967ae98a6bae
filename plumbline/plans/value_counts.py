"""One grouped count of every (column, value) pair of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ColumnInfo, col

# Values keep their own type, so that ties and ranks follow the natural order:
# i for integers, d for fractions, s for all else.
VALUE_FIELDS = ("i", "d", "s")


def _typed(info: ColumnInfo) -> str:
    if info.is_integral:
        return "i"
    return "d" if info.role == "numeric" else "s"


def unpivot(df: DataFrame, columns: list[ColumnInfo], keep: list[str] = ()) -> DataFrame:
    """Long form (keep..., column, i, d, s) of the non-null cells."""
    types = {"i": "bigint", "d": "double", "s": "string"}
    cells = []
    for info in columns:
        kind = _typed(info)
        cells.append(
            F.struct(
                F.lit(info.name).alias("column"),
                *[
                    (col(info.name) if f == kind else F.lit(None)).cast(types[f]).alias(f)
                    for f in VALUE_FIELDS
                ],
            )
        )
    long = df.select(*[col(k) for k in keep], F.explode(F.array(*cells)).alias("cell"))
    return long.select(*[col(k) for k in keep], "cell.*").where("coalesce(i, d) IS NOT NULL OR s IS NOT NULL")


def value_counts(df: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """(column, i, d, s, cnt): partial counts are combined before the shuffle,
    so a value that fills a third of the table costs one row per map task."""
    return unpivot(df, columns).groupBy("column", *VALUE_FIELDS).agg(F.count("*").alias("cnt"))


def distinct_counts(df: DataFrame, columns: list[ColumnInfo]) -> DataFrame:
    """(column, n): distinct non-null values, where nothing else is wanted."""
    return unpivot(df, columns).distinct().groupBy("column").agg(F.count("*").alias("n"))


def value_text() -> Column:
    return F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("d").cast("string"))


def summarise(counts: DataFrame) -> DataFrame:
    """Per column: distinct values, mode (smallest on ties) and entropy in nats.

    The totals, one row per column, need only hash aggregation. They then pick
    the commonest values out of the same shuffled counts, so that only ties are
    sorted rather than every distinct value.
    """
    n = F.col("cnt").cast("double")
    facts = counts.groupBy("column").agg(
        F.count("*").alias("distinct"), F.sum("cnt").alias("non_null"), F.max("cnt").alias("top_freq"),
        F.sum(n * F.ln(n)).alias("spread"),
    )
    tied = counts.join(F.broadcast(facts), "column").where("cnt = top_freq")
    best = tied.groupBy(*facts.columns).agg(F.min(F.struct(*VALUE_FIELDS)).alias("first"))
    return best.select(
        "column", "distinct", "non_null", "top_freq",
        (F.ln(F.col("non_null").cast("double")) - F.col("spread") / F.col("non_null")).alias("entropy"),
        *[F.col(f"first.{f}").alias(f) for f in VALUE_FIELDS],
    )


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` commonest values per column, ties by value.

    Spark limits each map task to ``k`` rows per column before the shuffle
    (WindowGroupLimit), so no task sees all values of a column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("cnt"), *VALUE_FIELDS)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
