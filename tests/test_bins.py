"""Trees on cells of bins: the same splits as on rows, in passes that do not grow with the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from plumbline.operators import forests, models, training
from plumbline.plans import bins

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two features of few values, one of as many as rows; classes and numbers that depend on all."""
    noise = F.xxhash64("id") % 1000 / 1000.0
    df = spark.range(20_000).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 20).cast("double").alias("b"), noise.alias("c"), (F.xxhash64("id", F.lit(2)) % 100).alias("n"),
    )
    score = F.col("a") + F.col("b") / 4 + 3 * F.col("c")
    return df.select("id", *NAMES, F.when(score + F.col("n") / 100 > 3, 1.0).otherwise(0.0).alias("y"), (score + F.col("n") / 10).alias("v")).localCheckpoint()


def features(rows, label):
    task = training.CLASSIFICATION if label == "y" else training.REGRESSION
    return training.Features(rows.select("id", *NAMES, F.col(label).alias("label")), ["id"], NAMES, label, task, ["lo", "hi"] if label == "y" else None)


@pytest.mark.parametrize("name, kinds", [("Decision Tree", {"y": DecisionTreeClassifier, "v": DecisionTreeRegressor}), ("Gradient Boosting", {"y": GBTClassifier, "v": GBTRegressor})])
@pytest.mark.parametrize("label", ["y", "v"])
def test_trees_pass_over_cells(rows, monkeypatch, name, kinds, label):
    monkeypatch.setattr(models, "BOOST_ROUNDS", 5)
    plain, met = kinds[label].fit, []

    def fit(self, data, params=None):
        met.append(data.count())
        return plain(self, data, params)

    monkeypatch.setattr(kinds[label], "fit", fit)
    made = features(rows, label)
    fitted = models.fit(name, made, made.df)
    assert met and max(met) <= 2 * 7 * 39 * bins.BINS < 20_000
    assert sum(fitted.importances.values()) == pytest.approx(1.0) and fitted.predict(made.df).where("prediction IS NULL").isEmpty()


@pytest.mark.parametrize("label", ["y", "v"])
def test_cells_split_as_rows(spark, rows, label):
    """Few values: the tree on cells predicts for every row what MLlib's tree on the rows does."""
    few = rows.withColumn("c", F.round("c", 1)).withColumn("b", F.abs("b"))
    made = features(few, label)
    own = models.fit("Decision Tree", made, made.df).predict(made.df).select("id", F.round("prediction", 9).alias("p"))
    kind = DecisionTreeClassifier if label == "y" else DecisionTreeRegressor
    assembled = VectorAssembler(inputCols=NAMES, outputCol="f").transform(made.df)
    plain = kind(maxDepth=10, seed=models.SEED, featuresCol="f", labelCol="label").fit(assembled).transform(assembled).select("id", F.round("prediction", 9).alias("q"))
    same = own.join(plain, "id").agg(F.avg((F.abs(F.col("p") - F.col("q")) < 1e-6).cast("double"))).first()[0]
    assert same > 0.995  # splits of equal gain may differ


def test_cuts(spark):
    many = spark.range(5000).select(F.lit(1.0).alias("one"), (F.col("id") % 2).cast("double").alias("two"), (F.col("id") % 50).cast("double").alias("fifty"), F.sqrt("id").alias("all"))
    one, two, fifty, whole = bins.feature_cuts(many, many.columns)
    assert one.tolist() == [] and two.tolist() == [0.5] and len(fifty) == bins.BINS - 1 and 24.5 in fifty
    assert 25 <= len(whole) <= bins.BINS - 1 and (np.diff(whole) > 0).all()
    edges = spark.createDataFrame([(float(x),) for x in (two[0], -np.inf, np.inf, 0.0, 1.0)], "two double")
    found = bins.bucketizer(["two"], [two]).transform(edges).collect()
    assert [r[1] for r in found] == [0.0, 0.0, 1.0, 0.0, 1.0]


@pytest.mark.parametrize("label", ["y", "v"])
def test_bags_draw_rows(spark, rows, monkeypatch, label):
    """Every tree draws as many rows as there are, give or take their root, and no more cells are kept than a task holds."""
    monkeypatch.setattr(forests, "HELD_CELLS", 300)
    kept, plain = [], forests.materialise

    def keep(df, name):
        kept.append(plain(df, name))
        return kept[-1]

    monkeypatch.setattr(forests, "materialise", keep)
    made = features(rows, label)
    model = forests.random_forest(made.df, NAMES, made.task, 2, trees=20, max_depth=8)
    drawn = np.array([r["drawn"] for r in kept[0].select("drawn").collect()]).sum(axis=0)
    assert len(drawn) == 20 and (np.abs(drawn - 20_000) < 6 * np.sqrt(20_000)).all() and len(set(drawn)) > 10
    if label == "v":
        sums = np.array([r["sums"] for r in kept[0].select("sums").collect()]).sum(axis=0)
        spread = rows.agg(F.sum(F.pow(F.col("v") - model.start[0], 2))).first()[0]
        assert (np.abs(sums) < 6 * np.sqrt(spread)).all() and (np.abs(sums) > 0).all()
    error = model.predict(made.df).agg(F.avg((F.col("label") != F.col("prediction")).cast("double")), F.avg(F.pow(F.col("label") - F.col("prediction"), 2)), F.var_pop("label")).first()
    assert error[0] < 0.1 if label == "y" else error[1] < 0.75 * error[2]  # two thirds are noise
    assert sum(model.importances().values()) == pytest.approx(1.0)


@pytest.mark.parametrize("label", ["y", "v"])
def test_cells_of_all_tasks_are_joined(rows, monkeypatch, label):
    """Passes meet a row a cell, however many tasks drew the bags."""
    kept, plain = [], forests.materialise

    def keep(df, name):
        kept.append(plain(df, name))
        return kept[-1]

    monkeypatch.setattr(forests, "materialise", keep)
    made = features(rows.withColumn("c", F.lit(1.0)).withColumn("b", F.abs("b") % 4).repartition(16), label)
    forests.random_forest(made.df, NAMES, made.task, 2, trees=5, max_depth=3)
    found = [frame.collect() for frame in (kept[0], kept[-1])]
    first, last = ({(*r["x"], r["y"]) for r in f} for f in found)
    assert first == last and len(found[1]) == len(last) < len(found[0]) / 8
    for part in ("drawn", "sums"):
        assert np.allclose(*(np.array([r[part] for r in f]).sum(axis=0) for f in found))
