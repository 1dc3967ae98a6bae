"""Folders of files with different columns and types."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions.frames import scratch_path
from plumbline.sources.csv import BadInput
from plumbline.sources.files import common_type, read_folder, reconcile


def write(spark, kind, *parts):
    path = scratch_path(spark, f"parts-{kind}")
    for i, df in enumerate(parts):
        df.coalesce(1).write.option("header", True).format(kind).save(f"{path}/{i}")
    return path


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_columns_meet_by_name(spark, kind):
    a = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "id bigint, t string, n int")
    b = spark.createDataFrame([(2.5, 3)], "n double, id bigint")
    c = spark.createDataFrame([(True, 4, "z")], "flag boolean, id bigint, t string")
    found = read_folder(spark, write(spark, kind, a, b, c, b), kind)
    assert set(found.columns) == {"id", "t", "n", "flag"}
    got = sorted((r["id"], r["t"], r["n"], r["flag"]) for r in found.collect())
    assert got == sorted([(1, "x", 2.0, None), (2, "y", 3.0, None), (3, None, 2.5, None), (3, None, 2.5, None), (4, "z", None, True)], key=lambda r: (r[0],))
    assert dict(found.dtypes)["n"] == "double"


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_clashes_are_reported(spark, kind):
    a = spark.createDataFrame([(1, True)], "id bigint, v boolean")
    b = spark.createDataFrame([(2, "word")], "id bigint, v string")
    path = write(spark, kind, a, b)
    if kind != "csv":
        with pytest.raises(BadInput, match="v: .*(?i:boolean).*(?i:string)"):
            read_folder(spark, path, kind)
    found = read_folder(spark, path, kind, clashes="text")
    assert sorted(r["v"].lower() for r in found.collect()) == ["true", "word"]


def test_common_types():
    assert common_type({"int", "bigint"}) == "bigint"
    assert common_type({"float", "bigint"}) == "double" and common_type({"float", "smallint"}) == "float"
    assert common_type({"void", "date"}) == "date" and common_type({"void"}) == "string"
    assert common_type({"date", "timestamp"}) == "timestamp"
    assert common_type({"decimal(10,2)", "decimal(12,4)", "int"}) == "decimal(14,4)"
    assert common_type({"decimal(38,0)", "decimal(38,10)"}) is None
    assert common_type({"boolean", "int"}) is None and common_type({"string", "date"}) is None


def test_case_missing_and_dates(spark):
    a = spark.sql("SELECT 1 AS Id, DATE '2024-01-02' AS d")
    b = spark.sql("SELECT 2L AS id, TIMESTAMP '2024-01-03 04:05:06' AS D, array(1) AS l")
    rows = reconcile([a, b]).orderBy("Id").collect()
    assert [tuple(r) for r in rows] == [(1, datetime.datetime(2024, 1, 2), None), (2, datetime.datetime(2024, 1, 3, 4, 5, 6), [1])]


def test_nothing_to_read(spark):
    path = write(spark, "parquet", spark.range(3))
    for kind in ("json", "csv"):
        with pytest.raises(BadInput, match="no .* files"):
            read_folder(spark, path, kind)
    with pytest.raises(BadInput, match="only"):
        read_folder(spark, path, "xml")
    with pytest.raises(BadInput):
        reconcile([])
    assert read_folder(spark, write(spark, "csv", spark.range(3), spark.range(2).limit(0).withColumn("x", F.lit(1))), "csv").count() == 3
