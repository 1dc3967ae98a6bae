"""What a table looks like: types, preview, versions, normalised values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, describe_columns
from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import finite, missing_token_to_null
from plumbline.plans.stats import TableStats, stats_of

PREVIEW_ROWS = 10


def schema_roles(table: DataFrame | TableStats) -> DataFrame:
    """Type, role and fill of every column."""
    return stats_of(table).missing_frame().select("pos", "column", "dtype", "role", "non_null")


def dtype_counts(table: DataFrame | TableStats) -> DataFrame:
    """Columns per type, and the values they hold."""
    return stats_of(table).missing_frame().groupBy("dtype").agg(
        F.count("*").alias("columns"), F.sum("non_null").alias("values")
    )


def preview(df: DataFrame, order_by: list[str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """First rows as text, missing values as empty text."""
    first = df.orderBy(*[col(c) for c in order_by]).limit(limit)
    return first.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def dataset_summary(table: DataFrame | TableStats) -> DataFrame:
    """Rows, columns and column names in one row."""
    st = stats_of(table)
    row = {"rows": st.counts["rows"], "columns": len(st.columns), "column_names": ",".join(c.name for c in st.columns)}
    return small_frame(st.spark, [row], "rows bigint, columns bigint, column_names string")


def version_select(original: DataFrame, cleaned: DataFrame | None = None, use_cleaned: bool = True) -> DataFrame:
    """The cleaned version when it exists and is wanted, else the original."""
    return cleaned if use_cleaned and cleaned is not None else original


def normalise_missing(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text, and NaN in numbers, become NULL."""
    output = []
    for c in describe_columns(df):
        if c.is_string:
            output.append(missing_token_to_null(col(c.name)).alias(c.name))
        elif c.dtype in ("float", "double"):
            output.append(F.when(~F.isnan(col(c.name)), col(c.name)).alias(c.name))
        else:
            output.append(col(c.name))
    return df.select(*output)


def sanitise_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL."""
    return df.select(
        *[finite(col(c.name)).alias(c.name) if c.dtype in ("float", "double") else col(c.name) for c in describe_columns(df)]
    )
