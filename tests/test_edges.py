"""Edge cases: empty, constant, all-missing and tiny tables, bad input."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline import TableStats
from plumbline.operators import anomaly, cleaning, dataset, explore, features, insights, profile, quality, report, training
from plumbline.sources import csv

TINY = [(1, 1.0, None, "a"), (2, 1.0, 2.0, None), (3, 2.0, None, "a"), (4, 100.0, 4.0, "b")]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, "id int, x double, half double, s string")


@pytest.fixture(scope="module")
def blank(spark):
    """A constant, an all-missing and a text column."""
    return spark.createDataFrame([(5.0, None, "k")] * 6, "same double, none double, word string")


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path, 'i,f,b,s,gap,odd\n1,1.5,True,x,NA,1\n-2,2,False,"a,b",3,12d\n3,1e3,true,null,,0x1\n')
    df = csv.read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "gap": "bigint", "odd": "string"}
    rows = df.orderBy("i").collect()
    assert [r["gap"] for r in rows] == [3, None, None]
    assert [r["s"] for r in rows] == ["a,b", "x", None]
    assert [r["f"] for r in rows] == [2.0, 1.5, 1000.0]


def test_csv_wide_integers(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path, "a,b\n9223372036854775807,9223372036854775808\nNA, 7 \n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double"}
    assert {r["a"] for r in df.collect()} == {2**63 - 1, None}


def test_csv_short_rows_are_filled(spark, tmp_path):
    assert csv.read_csv(spark, write(tmp_path, "a,b\n1,2\n3\n")).orderBy("a").collect()[1]["b"] is None


@pytest.mark.parametrize("text,name,message", [
    ("", "t.csv", "empty"), ("a,b\n", "t.csv", "no data rows"), ("a,b\n1,2,3\n", "t.csv", "more fields"), ("a\n1\n", "t.txt", "only .csv"),
])
def test_csv_rejects(spark, tmp_path, text, name, message):
    with pytest.raises(csv.BadInput, match=message):
        csv.read_csv(spark, write(tmp_path, text, name))


def test_csv_folder_with_other_headers(spark, tmp_path):
    for folder, second in (("same", "a,b\n3,4\n"), ("other", "b,a\n3,30\n")):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, "a,b\n1,2\n", "one.csv")
        write(tmp_path / folder, second, "two.csv")
    assert csv.read_csv(spark, str(tmp_path / "same")).count() == 2
    with pytest.raises(csv.BadInput, match="different headers"):
        csv.read_csv(spark, str(tmp_path / "other"))


@pytest.mark.parametrize("text", [
    "2024-02-29 10:11:12.345678", "2024-02-29T10:11:12Z", "2024-02-29T10:11:12.5+01:00", "2024-02-29 10:11", "02/29/2024 10:11", "Feb 29, 2024", "20240229", "2024-02-29",
])
def test_date_formats(spark, text):
    df = spark.createDataFrame([(i, text, "no date") for i in range(10)], "id int, day string, word string")
    assert features.date_columns(df, ["id"]) == ["day"]


def test_names_may_hold_the_pair_sign(spark):
    rows = [(float(i), float(2 * i), "x") for i in range(60)]
    df = spark.createDataFrame(rows, "`a & b` double, c double, s string")
    found = insights.insights_report(df).collect()
    assert [r["column"] for r in found if r["type"] == "correlation"] == ["a & b & c"]


def test_duplicates_tell_gaps_apart(spark):
    df = spark.createDataFrame([(None, 5), (5, None), (5, None), (0, 1)], "a long, b long")
    assert TableStats(df).duplicates == 1


def test_csv_row_cap_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, 'a,b\n3,"x\ny"\n1,z\n2,w\n')
    df = csv.read_csv(spark, path, multiline=True, row_cap=2, order_by=["a"])
    assert [r["a"] for r in df.orderBy("a").collect()] == [1, 2]
    assert csv.read_csv(spark, path, multiline=True).where("a = 3").first()["b"] == "x\ny"


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    row = quality.quality_score(df).first()
    assert (row["overall_score"], row["completeness"], row["uniqueness"]) == (100.0, 100.0, 100.0)
    assert profile.profile_numeric(df).count() == 0
    assert explore.histogram(df).count() == 0
    assert cleaning.apply_cleaning(df).df.count() == 0


def test_constant_and_missing_columns(blank):
    stats = {r["column"]: r for r in quality.column_stats_numeric(blank).collect()}
    assert stats["same"]["skewness"] == 0.0 and stats["same"]["kurtosis"] == 0.0 and stats["same"]["std"] == 0.0
    assert stats["none"]["mean"] is None and stats["none"]["missing_count"] == 6
    assert {r["column"]: r["value"] for r in insights.insight_constant(blank).collect()} == {"same": 1.0, "none": 0.0, "word": 1.0}
    assert all(r["r"] is None for r in profile.correlation_matrix(blank).collect())
    assert explore.histogram(blank).select("column", "bin", "count").collect() == [("same", 0, 6)]
    assert anomaly.iqr_column_summary(blank).count() == 0


def test_all_missing_columns_fill_as_promised(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "n double, s string, id int")
    mean = cleaning.apply_cleaning(df, "mean", handle_outliers=False)
    assert mean.df.where("n IS NULL").count() == 2
    assert [(r["action"], r["value"]) for r in mean.log().collect()] == [("fill_mean", None)]
    mode = cleaning.fill_missing(df, "mode").collect()
    assert {(r["n"], r["s"]) for r in mode} == {(0.0, "Unknown")}


def test_tiny_table_guards(tiny):
    outliers = {r["column"]: r["outliers"] for r in quality.iqr_outliers(tiny).collect()}
    assert outliers["half"] == 0 and outliers["x"] == 1
    kept = {r["column"]: r["keep"] for r in training.keep_columns(tiny, "x", ["id"]).collect()}
    assert kept == {"x": True, "half": False, "s": True}
    with pytest.raises(ValueError, match="not enough rows"):
        training.prepare_features(tiny, "x", ["id"], training.REGRESSION)
    assert features.suggest_zscore(tiny).count() == 0


def test_dropping_a_column_hides_rows_from_later_ones(spark):
    df = spark.createDataFrame([(None, 100.0), (1.0, 1.0), (2.0, 3.0), (3.0, None)], "a double, b double")
    done = cleaning.apply_cleaning(df, "mean", False, False, custom_column_strategies={"a": "drop"})
    assert sorted(r["b"] for r in done.df.collect()) == [1.0, 2.0, 3.0]
    assert [(r["column"], r["action"], r["affected"]) for r in done.log().collect()] == [("a", "drop_rows", 1), ("b", "fill_mean", 1)]
    assert done.summary().first().asDict() == {"rows_before": 4, "rows_after": 3, "rows_removed": 1}


def test_strategy_that_does_not_apply_leaves_the_column(spark):
    df = spark.createDataFrame([("x", 1.0), (None, None)], "s string, n double")
    kept = cleaning.fill_missing(df, "none", {"s": "mean", "n": "typo"})
    assert kept.where("s IS NULL AND n IS NULL").count() == 1


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert quality.missing_by_column(df).first()["missing"] == 2
    clean = dataset.sanitise_nonfinite(spark.createDataFrame([(math.inf,), (math.nan,), (2.0,)], "x double"))
    assert clean.where("x IS NULL").count() == 2


def test_booleans_and_dates_are_categorical(spark):
    df = spark.sql("SELECT true AS b, DATE'2020-01-01' AS d, 1 AS n, array(1) AS a")
    roles = {r["column"]: r["role"] for r in dataset.schema_roles(df).collect()}
    assert roles == {"b": "categorical", "d": "categorical", "n": "numeric", "a": "nested"}
    assert features.date_columns(df, ["n"]) == ["d"]


def test_maps_stay_out_of_row_comparison(spark):
    df = spark.sql("SELECT 1 AS n, 'a' AS s, map('k', 1) AS m FROM range(3)")
    assert TableStats(df).duplicates == 2
    assert cleaning.drop_duplicates(df).count() == 1
    assert quality.quality_score(df).first()["columns"] == 3


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    with pytest.raises(ValueError, match="numeric"):
        anomaly.iforest_scores(df, ["s"])
    assert quality.quality_score(df).first()["outlier_score"] == 100.0
    assert explore.category_bars(df).count() == 2


def test_quartile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3, 4, 5)], "x double")
    assert [r["x_bin"] for r in features.add_quartile_bin(df, ["x"]).collect()] == [0, 0, 0, 0, 1, 1, 2, 2]


def test_encoding_rules():
    kinds = [features.encoding_of(n)[0] for n in (0, 1, 2, 3, 10, 11, 50, 51)]
    assert kinds == ["onehot", "onehot", "binary_encode", "onehot", "onehot", "target_encode", "target_encode", "hash_encode"]


def test_one_hot_refuses_many_values(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="one-hot"):
        features.add_onehot(df, ["s"])


def test_date_formats(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-29 10:11:12",), ("02/29/2024",), ("29 Feb 2024",), ("soon",)], "t string")
    rows = features.add_date_parts(df, ["t"]).collect()
    assert [(r["t_year"], r["t_month"], r["t_weekday"]) for r in rows[:4]] == [(2024, 2, 3)] * 4
    assert rows[4]["t_year"] is None


def test_report_is_written_as_json(spark, tiny, tmp_path):
    path = str(tmp_path / "report")
    found = report.report_long(tiny)
    report.write_report(found, path)
    assert spark.read.json(path).count() == found.count()


def test_interaction_pairs_by_strength(spark):
    df = spark.createDataFrame([(float(i), float(i) + (i % 3), -float(i)) for i in range(20)], "a double, b double, c double")
    assert features.interaction_pairs(df, limit=1) == [("a", "b")]
    assert features.interaction_pairs(df, limit=1, rank_by="strength") == [("a", "c")]
    assert TableStats(df).correlations[("a", "c")] == pytest.approx(-1.0)


def test_target_errors(tiny):
    with pytest.raises(ValueError, match="not found"):
        training.task_automl(tiny, "nope")
    with pytest.raises(ValueError, match="mostly missing"):
        training.prepare_features(tiny, "half", ["id"], training.REGRESSION)
