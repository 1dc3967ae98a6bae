"""The first values of every column in an order, from one scan for all columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col

#: Rows that a task sorts at once.
SORT_ROWS = 50_000


def first_values(df: DataFrame, names: list[str], order_by: list[str], limit: int) -> DataFrame:
    """``p, rank, value``: the first ``limit`` non-null values of the columns ``names`` (by position ``p``), nulls of the order first.

    A task holds at most ``limit`` values a column and sends no more.
    """
    orders, values = [f"o{i}" for i in range(len(order_by))], [f"v{i}" for i in range(len(names))]
    rows = df.select(*[col(c).alias(o) for c, o in zip(order_by, orders)], *[col(c).cast("double").alias(v) for c, v in zip(names, values)])
    schema = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("value", T.DoubleType()), *rows.select(*orders).schema.fields])
    order = Window.partitionBy("p").orderBy(*orders)
    found = rows.mapInArrow(_firsts(orders, len(names), limit), schema).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= limit).select("p", "rank", "value")


def _firsts(orders: list[str], columns: int, limit: int):
    def sort(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table, sort_keys=[(o, "ascending") for o in orders], null_placement="at_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table | None] = [None] * columns
        held: list[pa.RecordBatch] = []

        def meet() -> None:
            rows = sort(pa.Table.from_batches(held))
            held.clear()
            for p in range(columns):
                value = rows.column(f"v{p}")
                mine = rows.select(orders).append_column("value", value).filter(pc.is_valid(value)).slice(0, limit)
                kept[p] = mine if kept[p] is None else sort(pa.concat_tables([kept[p], mine])).slice(0, limit)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SORT_ROWS:
                meet()
                size = 0
        if size:
            meet()
        for p, table in enumerate(kept):
            if table is not None and table.num_rows:
                at = pa.array([p] * table.num_rows, pa.int32())
                yield from pa.Table.from_arrays([at, table.column("value"), *(table.column(o) for o in orders)], ["p", "value", *orders]).combine_chunks().to_batches()

    return run
