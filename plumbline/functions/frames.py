"""Small result frames and written intermediates."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.columns import col


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded report (a row per column, pair or rule) as a local relation.

    Catalyst folds filters and projections over it without starting a job.
    """
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    data = [[row.get(f.name) for row in rows] for f in struct.fields]
    table = pa.Table.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(data, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema=struct)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names, or in the warehouse, which is shared as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/plumbline-{label}-{uuid.uuid4().hex}"


def deal_out(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows over all cores, when they arrive in fewer partitions than there are
    cores and much work per row follows. A large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[col(k) for k in key])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, cutting its lineage.

    Parquet rather than a checkpoint, as later passes read only some columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
