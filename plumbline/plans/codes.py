"""Ordinal codes of text values in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import materialise, small_frame

# Above this many distinct values, or bytes of them, codes are numbered in range
# buckets and joined by shuffle; below it, one sort and a broadcast.
CODE_LIMIT = 100_000
CODE_BYTES = 64 * 2**20
BUCKETS = 512


def text_codes(df: DataFrame, column: str, null_text: str | None = None, limit: int = CODE_LIMIT) -> tuple[DataFrame, bool]:
    """(value, code) with code = 0-based rank of the value in sorted order, and
    whether the table is small enough to broadcast.

    ``null_text`` gives missing values a category of that name.
    """
    value = col(column).cast("string")
    if null_text is not None:
        value = F.coalesce(value, F.lit(null_text))
    return number_values(df.select(value.alias("value")), limit)[:2]


def number_values(rows: DataFrame, limit: int = CODE_LIMIT) -> tuple[DataFrame, bool, int]:
    """(value, code) of the distinct non-null values of ``rows`` (value), of any type with an order; whether they are few; how many."""
    values = rows.where("value IS NOT NULL").distinct()
    value = F.col("value").cast("string")
    size, width = values.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(value).cast("bigint")), F.lit(0))).first()
    if size <= limit and width <= CODE_BYTES:
        order = Window.orderBy("value")
        return values.select("value", (F.row_number().over(order) - 1).alias("code")), True, size
    return _bucketed(values), False, size


def _bucketed(values: DataFrame) -> DataFrame:
    """Range buckets of whole values, each numbered in its own task and shifted
    by the sizes of the buckets before it."""
    tagged = materialise(values.repartitionByRange(BUCKETS, "value").withColumn("bucket", F.spark_partition_id()), "codes")
    sizes = {r["bucket"]: r["count"] for r in tagged.groupBy("bucket").count().collect()}
    offsets, total = [], 0
    for b in sorted(sizes):
        offsets.append({"bucket": b, "offset": total})
        total += sizes[b]
    shift = F.broadcast(small_frame(values.sparkSession, offsets, "bucket int, offset bigint"))
    order = Window.partitionBy("bucket").orderBy("value")
    numbered = tagged.withColumn("rn", F.row_number().over(order)).join(shift, "bucket")
    return numbered.select("value", (F.col("rn") - 1 + F.col("offset")).alias("code"))


def apply_codes(df: DataFrame, column: str, codes: DataFrame, small: bool, alias: str, null_text: str | None = None) -> DataFrame:
    """Replace ``column`` by its code. A large code table joins by shuffle,
    where adaptive skew handling splits the partition of a hot value."""
    value = col(column).cast("string")
    if null_text is not None:
        value = F.coalesce(value, F.lit(null_text))
    lookup = codes.select(F.col("value").alias("code_value"), F.col("code").alias("code_number"))
    if small:
        lookup = F.broadcast(lookup)
    joined = df.withColumn("code_key", value).join(lookup, F.col("code_key") == F.col("code_value"), "left")
    kept = [F.col("code_number").alias(alias) if c == column else col(c) for c in df.columns]
    return joined.select(*kept)
