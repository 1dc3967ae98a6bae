"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col
from plumbline.functions.scalar import NUMERIC_TEXT, missing_token_to_null

OVERFLOW = "plumbline extra field"

# Text that reads as an integer, and as a boolean.
INTEGER_TEXT = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
BOOLEAN_TEXT = r"^(True|False|TRUE|FALSE|true|false)$"


class BadInput(ValueError):
    """The file cannot be used as a table."""


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = False, row_cap: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """A CSV file, a folder of them, or a list of files, with a header and inferred types.

    Missing-value tokens become NULL before types are inferred, so a numeric
    column with ``NA`` in it stays numeric. Raises ``BadInput`` for another
    extension, an empty file, rows wider than the header, or no rows. Files
    are split and read in parallel unless ``multiline`` allows line breaks
    inside quotes. ``row_cap`` keeps the first rows by ``order_by``.
    """
    options = {"header": True, "multiLine": multiline, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _check_extension(spark, path)
    names = spark.read.options(**options).csv(path).columns
    if not names:
        raise BadInput(f"{path} is empty")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
    _check_headers(spark, path, names, options)
    raw = spark.read.options(**options).schema(schema).csv(path)
    typed = _typed(raw, names)
    if row_cap is not None:
        typed = cap_rows(typed, order_by or names, row_cap)
    return typed


def _check_extension(spark: SparkSession, path: str | list[str]) -> None:
    if all(p.endswith(".csv") for p in ([path] if isinstance(path, str) else path)):
        return
    files = spark.read.format("binaryFile").load(path).select("path")
    bad = files.where(~F.col("path").rlike(r"\.csv$")).limit(1).collect()
    if bad:
        raise BadInput(f"only .csv files are read, not {bad[0]['path']}")


def _check_headers(spark: SparkSession, path: str | list[str], names: list[str], options: dict) -> None:
    """Columns are read by position, so every file of a folder needs the same header.

    Spark compares them as it opens the files; no task reads beyond its first batch.
    """
    if spark.read.format("binaryFile").load(path).select("path").limit(2).count() < 2:
        return
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(**options, enforceSchema=False).schema(schema).csv(path)
    try:
        rows.mapInArrow(lambda batches: iter(()), "none int").count()
    except Exception as failure:
        if "header" in str(failure):
            raise BadInput(f"the files under {path} have different headers; the first is {','.join(names)}") from failure
        raise


def _typed(raw: DataFrame, names: list[str]) -> DataFrame:
    """Infer and apply types in one pass over the text."""
    clean = raw.select(*[missing_token_to_null(col(n)).alias(n) for n in names], col(OVERFLOW))
    aggs = [F.count(F.lit(1)).alias("rows"), F.count(col(OVERFLOW)).alias("wide")]
    for i, n in enumerate(names):
        whole = col(n).rlike(INTEGER_TEXT) & F.trim(col(n)).try_cast("bigint").isNotNull()
        fits = {"int": whole, "num": col(n).rlike(NUMERIC_TEXT), "bool": col(n).rlike(BOOLEAN_TEXT)}
        for kind, test in fits.items():
            all_fit = F.bool_and(F.when(col(n).isNotNull(), test))
            aggs.append(F.coalesce(all_fit, F.lit(False)).alias(f"{kind}{i}"))
        aggs.append(F.count(col(n)).alias(f"n{i}"))
    row = clean.agg(*aggs).first()
    if not row["rows"]:
        raise BadInput("the file has no data rows")
    if row["wide"]:
        raise BadInput(f"{row['wide']} rows have more fields than the header")
    output = []
    for i, n in enumerate(names):
        text = F.trim(col(n))
        if row[f"int{i}"]:
            output.append(text.cast("bigint").alias(n))
        elif row[f"num{i}"] or not row[f"n{i}"]:
            output.append(text.cast("double").alias(n))
        elif row[f"bool{i}"] and row[f"n{i}"] == row["rows"]:
            output.append((F.lower(text) == "true").alias(n))
        else:
            output.append(col(n))
    return clean.select(*output)


def cap_rows(df: DataFrame, order_by: list[str], limit: int = 100_000) -> DataFrame:
    """First rows in the given order. Off unless asked for: Spark needs no cap."""
    return df.orderBy(*[col(c) for c in order_by]).limit(limit)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, one per partition."""
    df.write.mode("overwrite").option("escape", '"').csv(path, header=True)
