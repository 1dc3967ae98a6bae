"""Dates in text, however spelled."""

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import features
from plumbline.plans import dates

SPELLINGS = [
    ("2/9/2024", (2024, 2, 9)), ("29.02.2024", (2024, 2, 29)), ("2024-02", (2024, 2, 1)), ("Feb 2024", (2024, 2, 1)), ("February 29, 2024", (2024, 2, 29)),
    ("02/29/24", (2024, 2, 29)), ("Thu Feb 29 2024", (2024, 2, 29)), ("2024/02/29 10:11:12", (2024, 2, 29)), ("3-Feb-2024", (2024, 2, 3)),
    ("2024-02-29 10:11:12 AM", (2024, 2, 29)), ("10:30 AM 2024", (2024, 1, 1)), ("2024-02-29", (2024, 2, 29)), ("2024-02-29T10:11:12.123Z", (2024, 2, 29)),
    ("2024-02-29 23:59:59+02:00", (2024, 2, 29)), ("20240229", (2024, 2, 29)), ("  12 March 1999 ", (1999, 3, 12)), ("May 3rd 2001", (2001, 5, 3)), ("1/2/70", (1970, 1, 2)),
    ("1/2/68", (2068, 1, 2)), ("2024-Sep-07", (2024, 9, 7)), ("Sept 7, 2024", (2024, 9, 7)), ("Sunday, 3 July 2022 4:05 pm", (2022, 7, 3)),
    ("2023-02-29", None), ("31.04.2024", None), ("13/13/2024", None), ("2024", None), ("12d", None), ("", None), ("   ", None), (None, None), ("Mayor 2024", None),
    ("part 12", None), ("1234.5", None), ("10:30", None), ("0000-00-00", None), ("x" * 100_000, None), ("2024-02-29 and more", None),
]


def test_spellings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPELLINGS)], "id int, t string")
    rows = df.select("id", dates.parse(F.col("t")).cast("date").alias("d"), dates.shape_of(F.col("t")).alias("s")).orderBy("id").collect()
    for r, (text, want) in zip(rows, SPELLINGS):
        assert r["d"] == (datetime.date(*want) if want else None), text
        assert r["s"] is not None or want is None, text


@pytest.mark.parametrize("rows, want", [
    (["1/2/2024", "3/4/2024", "25/12/2024"], [2, 4, 12]),  # one value settles all
    (["1/2/2024", "3/4/2024", "12/25/2024"], [1, 3, 12]),
    (["1/2/2024", "3/4/2024", "5/6/2024"], [1, 3, 5]),  # nothing tells: the month comes first
    (["13/1/2024", "14/1/2024", "1/15/2024"], [1, 1, 1]),  # the others are read as they can be
])
def test_the_column_settles_day_and_month(spark, rows, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    assert [r["t_month"] for r in features.add_date_parts(df, ["t"]).orderBy("id").collect()] == want


def test_typed_and_empty_columns(spark):
    df = spark.sql("SELECT 1 AS id, DATE '2024-02-29' AS a, TIMESTAMP '2024-02-29 23:00:00' AS b, CAST(NULL AS STRING) AS c")
    row = features.add_date_parts(df, ["a", "b", "c"]).first()
    assert (row["a_year"], row["a_weekday"], row["b_month"], row["c_year"]) == (2024, 3, 2, None)
    assert features.add_date_parts(df.limit(0), ["c"]).collect() == []
    assert features.date_columns(df, ["id"]) == ["a", "b"]


def test_patterns_are_tried_once_a_layout(monkeypatch):
    """Ten thousand days of two layouts cost two rounds of patterns; the digits are read off all values at once."""
    tried, plain = [], dates._layout
    monkeypatch.setattr(dates, "_layout", lambda text: tried.append(text) or plain(text))
    days = [datetime.date(1995, 1, 1) + datetime.timedelta(i) for i in range(5000)]
    reader = dates._Reader()
    texts = pa.array([*(d.strftime("%Y-%m-%d 10:11:12") for d in days), *(d.strftime("%d.%m.%Y") for d in days), None, "", "no digit", "é 12"])
    assert reader.days(texts.slice(0, 5000), False).to_pylist() == days
    assert reader.days(texts, True).to_pylist() == [*days, *days, None, None, None, None]
    assert sorted(set(tried)) == sorted(tried) == ["00.00.0000", "0000-00-00 00:00:00", "é 00"]


def test_line_ends_and_first_values(spark):
    """A line end after a year is no part of it; of equal keys the smaller texts come first."""
    df = spark.createDataFrame([(i, "10:30 2024\u2028") for i in range(3)], "id int, t string")
    assert {r["t_year"] for r in features.add_date_parts(df, ["t"]).collect()} == {2024}
    rows = [(1 if i < 200 else None, f"x{i:03d}" if i % 2 else f"{i:03d}-01-01", None if i else "2024-01-01") for i in range(220)]
    rows = spark.createDataFrame(rows, "k int, t string, u string")
    assert features.date_columns(rows, ["k"]) == ["u"]
    late = spark.createDataFrame([(i, "2024-01-01" if i >= 50 else f"x{i}") for i in range(5000)], "k int, t string").repartition(5)
    assert features.date_columns(late, ["k"]) == [] and features.date_columns(late.where("k >= 40"), ["k"]) == []
    assert features.date_columns(late.where("k >= 41"), ["k"]) == ["t"]
