"""Shared passes against brute force on small data, and the shape of plans."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog.fixtures import table
from plumbline import TableStats
from plumbline.operators import anomaly, profile, training
from plumbline.operators.training import label_encode
from plumbline.plans import firsts, quantiles, value_counts
from plumbline.plans.codes import text_codes


def plan_of(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "plain": rng.normal(size=6000),
        "hot": np.where(rng.random(6000) < 0.4, 5.0, rng.integers(0, 9, 6000).astype(float)),
        "far": np.where(rng.random(6000) < 0.01, 1e300, rng.random(6000)),
        "flat": 3.0,
    })
    pdf.loc[::7, "plain"] = np.nan
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("limit,sample", [(10**6, 100), (100, 150), (10, 40)])
def test_quantiles_equal_numpy(numbers, limit, sample):
    df, pdf = numbers
    st = TableStats(df)
    probs = [0.0, 0.25, 0.5, 0.613, 0.95, 1.0]
    found = quantiles.quantiles(st, {c: st.counts["non_null"][c] for c in pdf}, probs, exact_limit=limit, sample_size=sample)
    for c in pdf:
        want = pdf[c].dropna().quantile(probs).tolist()
        assert found[c] == pytest.approx(want, rel=1e-12), c


def test_quantiles_of_a_wide_table(spark):
    """Three hundred columns: every bracket is a group of its own, and only picked values reach the driver."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(400, 300)), columns=[f"c{i}" for i in range(300)])
    st = TableStats(spark.createDataFrame(pdf))
    found = quantiles.quantiles(st, {c: 400 for c in pdf}, [0.25, 0.5], exact_limit=100, sample_size=150)
    want = pdf.quantile([0.25, 0.5])
    for c in ("c0", "c17", "c299"):
        assert found[c] == pytest.approx(want[c].tolist(), rel=1e-12)


def test_moments_equal_pandas(numbers):
    df, pdf = numbers
    moments = TableStats(df.drop("far")).moments
    for c in ("plain", "hot", "flat"):
        s = pdf[c].dropna()
        assert moments[c]["mean"] == pytest.approx(s.mean())
        assert moments[c]["std"] == pytest.approx(s.std(), abs=1e-12)
        assert moments[c]["skewness"] == pytest.approx(s.skew(), abs=1e-9)
        assert moments[c]["kurtosis"] == pytest.approx(s.kurtosis(), abs=1e-9)


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=500)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(size=500), "c": rng.random(500), "k": 1.0})
    pdf.loc[::5, "b"] = np.nan
    pdf.loc[::3, "c"] = np.nan
    found = TableStats(spark.createDataFrame(pdf)).correlations
    want = pdf.corr()
    for (x, y), r in found.items():
        assert (r is None) if np.isnan(want.loc[x, y]) else r == pytest.approx(want.loc[x, y], abs=1e-12)


def test_approximate_statistics_stay_close(numbers):
    df, pdf = numbers
    st = TableStats(df.select("plain"), approx=True)
    assert st.quantiles([0.5])["plain"][0] == pytest.approx(pdf["plain"].median(), abs=0.02)
    assert st.distinct(st.numeric)["plain"] == pytest.approx(pdf["plain"].nunique(), rel=0.15)


def test_bucketed_codes_equal_sorted_rank(spark):
    random.seed(1)
    values = sorted({"".join(random.choices("abXYé☃ 0", k=5)) for _ in range(3000)}, key=lambda s: s.encode())
    df = spark.createDataFrame([(v,) for v in values + values[:50]], "v string")
    codes, small = text_codes(df, "v", limit=10)
    assert not small
    found = {r["value"]: r["code"] for r in codes.collect()}
    assert found == {v: i for i, v in enumerate(values)}


def test_label_encode_gives_missing_its_own_category(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("z",)], "v string")
    assert [r[0] for r in label_encode(df, ["v"]).collect()] == [1, 2, 0, 3]


def test_duplicates_count_whole_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (None, "a")], "x int, y string")
    assert TableStats(df).duplicates == 3


def test_top_k_limits_rows_before_the_shuffle(spark, sf_dir):
    st = TableStats(table(spark, sf_dir, "fx_rules"))
    plan = plan_of(value_counts.top_k(st.value_counts(st.categorical), 20))
    assert "row_number(), 20, Partial" in plan


def test_value_counts_combine_before_the_shuffle(spark, sf_dir):
    st = TableStats(table(spark, sf_dir, "fx_dups"))
    assert "partial_count" in plan_of(st.value_counts(st.categorical))


def test_summary_shuffles_the_counts_once(spark, sf_dir):
    st = TableStats(table(spark, sf_dir, "fx_rules"))
    summary = value_counts.summarise(st.value_counts(st.categorical))
    found = {r["column"]: r for r in summary.collect()}
    assert found["seg"]["s"] == "A" and found["seg"]["distinct"] == 2 and found["const_text"]["entropy"] == 0.0
    assert "ReusedExchange" in plan_of(summary)


def test_duplicates_shuffle_hashes(spark, sf_dir):
    assert TableStats(table(spark, sf_dir, "fx_dups")).duplicates == table(spark, sf_dir, "fx_dups").count() - table(spark, sf_dir, "fx_dups").distinct().count()


def test_statistics_read_only_their_columns(spark, sf_dir):
    st = TableStats(table(spark, sf_dir, "lineitem").select("l_tax", "l_returnflag"))
    assert "ReadSchema: struct<l_tax:double>" in plan_of(st.numeric_long(["l_tax"]).groupBy("p").agg(F.avg("x")))


def test_column_names_are_literal(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, None)], ["a.b", "c`d"])
    st = TableStats(df)
    assert st.moments["a.b"]["mean"] == 1.5
    assert st.value_summary(st.categorical)["c`d"]["distinct"] == 1
    assert st.duplicates == 0


# -- passes -----------------------------------------------------------------------------


def test_quantiles_of_smooth_data_take_one_counting_scan(spark, monkeypatch):
    """The moments pass gives the first brackets; no sample is drawn."""
    df = spark.range(250_000).select(F.randn(1).alias("a"), F.exp(F.randn(2)).alias("b"), (F.col("id") % 7).cast("double").alias("ties"))
    st = TableStats(df, exact_limit=1000)
    st.counts, st.moments
    scans, plain = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: scans.append(1) or plain(*a))
    monkeypatch.setattr(quantiles, "_pivots", None)
    monkeypatch.setattr(quantiles, "SAMPLE_SIZE", 20_000)
    monkeypatch.setattr(TableStats, "numeric_long", None)  # the sketches are there already
    monkeypatch.setattr(quantiles.select_ranks, "__defaults__", (20_000, None))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = quantiles.quantiles(st, {c: 250_000 for c in ("a", "b", "ties")}, probs, exact_limit=1000, sample_size=20_000)
    pdf = df.toPandas()
    for c in pdf:
        assert found[c] == pytest.approx(np.quantile(pdf[c], probs).tolist(), rel=1e-12), c
    assert len(scans) == 1


def test_task_rule_shuffles_a_few_values(spark):
    df = spark.range(100_000).select((F.col("id") % 1000).alias("many"), (F.col("id") % 14).cast("double").alias("few"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("one"))
    few = training.few_values(df, "many", 15)
    assert few.count() <= 15 * few.rdd.getNumPartitions()
    assert "Exchange" not in plan_of(few)
    plan = plan_of(few.distinct())
    assert plan.index("Exchange") < plan.index("MapInArrow")  # printed top down: only the few values are shuffled
    assert [training._distinct_up_to(df, c, 15) for c in ("many", "few", "one")] == [15, 14, 1]
    assert training.task_automl(df, "few") == training.CLASSIFICATION and training.task_automl(df, "many") == training.REGRESSION
    assert training._distinct_up_to(df.limit(0), "few", 15) == 0


def test_forest_draw_makes_no_row_per_tree(spark):
    df = spark.range(20_000).select("id", F.randn(3).alias("v"))
    draws = anomaly.forest_draws(df, ["id"])
    assert "Generate" not in plan_of(draws)
    counts = {r["tree"]: r["count"] for r in draws.groupBy("tree").count().collect()}
    assert counts == {t: 256 for t in range(100)}
    again = anomaly.forest_draws(df.repartition(13), ["id"])
    assert draws.exceptAll(again).isEmpty() and again.exceptAll(draws).isEmpty()
    # trees share no more rows than chance has them share
    shared = draws.groupBy("identity").count()
    assert shared.agg(F.max("count")).first()[0] < 12 and shared.count() > 13_000


def test_first_values_of_fifty_columns_take_one_scan(spark, monkeypatch):
    monkeypatch.setattr(firsts, "SORT_ROWS", 700)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(3000, 50)), columns=[f"c{i}" for i in range(50)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.3)
    pdf["c7"] = np.nan
    pdf["when"] = rng.permutation(3000)
    pdf["k"] = [None if i % 40 == 0 else f"k{i % 30:02d}" for i in range(3000)]
    df = spark.createDataFrame(pdf).repartition(5)
    found = profile.numeric_sample(df, ["k", "when"], 90)
    assert plan_of(found).count("MapInArrow") == 1 and plan_of(found).count("Scan") == 1
    got = {c: list(g.sort_values("rank")["value"]) for c, g in found.toPandas().groupby("column")}
    order = pdf.sort_values(["k", "when"], na_position="first")
    assert "c7" not in got
    for c in ("c0", "c31", "c49", "when"):
        assert got[c] == order[c].dropna().head(90).tolist(), c
