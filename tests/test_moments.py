"""Moments by batches against plain sums over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import moments
from plumbline.plans.stats import TableStats


def test_moments_equal_plain_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b) if i % 3 else None, 0.1, 1e9 + float(c), None, int(c * 3)) for i, (a, b, c) in enumerate(zip(rng.exponential(size=30_000), rng.normal(size=30_000), rng.random(30_000)))]
    df = spark.createDataFrame(rows, "a double, b double, flat double, far double, none double, i int").repartition(7)
    found = moments.moments(df, df.columns)
    assert set(found) == {"a", "b", "flat", "far", "i"}
    x = F.col
    for c, m in found.items():
        want = df.agg(F.count(c), F.avg(c), F.var_samp(c), F.skewness(c), F.kurtosis(c), F.min(c), F.max(c), F.count_if(x(c) == 0), F.count_if(x(c) < 0)).first()
        got = [m[k] for k in ("n", "mean", "variance", "g1", "g2", "min", "max", "zeros", "negatives")]
        assert got == [v if v is None or isinstance(v, int) else pytest.approx(v, rel=1e-5 if c == "far" else 1e-9, abs=1e-4 if c == "far" else 1e-9) for v in want]
    assert found["flat"]["variance"] == 0 and found["flat"]["g1"] is None and found["flat"]["mean"] == 0.1


def test_moments_of_odd_columns(spark):
    df = spark.createDataFrame([(math.inf, 1.0, math.inf), (2.0, None, -math.inf), (3.0, None, math.nan)], "a double, one double, both double").repartition(3)
    m = TableStats(df).moments
    assert m["a"]["mean"] == math.inf and math.isnan(m["a"]["variance"]) and m["a"]["max"] == math.inf
    assert (m["one"]["n"], m["one"]["std"], m["one"]["g1"]) == (1, None, None)
    assert m["both"]["n"] == 2 and math.isnan(m["both"]["mean"])
    assert TableStats(df.limit(0)).moments["a"]["n"] == 0


def test_no_row_a_cell(spark):
    """The plan makes no row of every cell, which cost more than all sums."""
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), F.sqrt("id").alias("b"))
    seen = []
    plain = type(df).mapInArrow

    def spy(self, run, schema):
        seen.append(self._jdf.queryExecution().toString())
        return plain(self, run, schema)

    type(df).mapInArrow = spy
    try:
        assert TableStats(df).moments["a"]["mean"] == 49.5
    finally:
        type(df).mapInArrow = plain
    assert len(seen) == 1 and "Generate" not in seen[0]
