"""Trees over all values of the features, and forests larger than the driver holds: nothing is left out."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from plumbline.functions.frames import scratch_path
from plumbline.operators import forests, leaderboard, models, splits, subtrees, training
from plumbline.plans import bins
from tests.test_forests import frame, table_of


def fine_table(seed, n=3000):
    """A feature of as many values as rows, one of few, one skewed; classes and numbers that turn at one value."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.permutation(n) + 0.5, rng.integers(0, 5, n).astype(float), np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n) ** 3)], axis=1)
    return x, ((x[:, 0] > 1234) ^ (rng.random(n) < 0.1)).astype(int), np.where(x[:, 0] > 1234, 3.0, 0.0) + x[:, 2] + rng.normal(size=n)


def plain_tree(x, y, classes, depth, path=()):
    """Cuts by path of the tree with the best split over all values, one row at a time."""
    def gini(t):
        return len(t) - (np.bincount(t, minlength=classes) ** 2).sum() / len(t) if classes else ((t - t.mean()) ** 2).sum()

    best = (1e-9, None, None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gain = gini(y) - gini(y[low]) - gini(y[~low])
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    if best[1] is None:
        return {}
    low = x[:, best[1]] <= best[2]
    return {path: best[1:]} | plain_tree(x[low], y[low], classes, depth - 1, (*path, 0)) | plain_tree(x[~low], y[~low], classes, depth - 1, (*path, 1))


@pytest.mark.parametrize("task", [training.CLASSIFICATION, training.REGRESSION])
def test_trees_try_every_value(spark, task):
    x, c, v = fine_table(1)
    y = c if task == training.CLASSIFICATION else v
    names, df = frame(spark, x, y)
    model = forests.decision_tree(df, names, task, 2, max_depth=3)
    want = plain_tree(x, y, 2 if task == training.CLASSIFICATION else 0, 3)
    forest, found = model.forest, {}

    def walk(node, rows, path):
        if forest.feature[node] >= 0:
            f, cut = forest.feature[node], forest.threshold[node]
            found[path] = (f, rows[rows[:, f] <= cut, f].max())
            walk(forest.left[node], rows[rows[:, f] <= cut], (*path, 0))
            walk(forest.left[node] + 1, rows[rows[:, f] > cut], (*path, 1))

    walk(forest.roots[0], x, ())
    assert found == want


def test_hidden_values_are_few(spark, monkeypatch):
    """Where a border is better than what a bin can hide, its values are not sorted."""
    x, y, _ = fine_table(2)
    names, df = frame(spark, x, (x[:, 0] > 1234).astype(int))
    seen, plain = [], splits._edges
    monkeypatch.setattr(splits, "_edges", lambda before, total, classes: seen.append(len(before)) or plain(before, total, classes))
    forest = forests.decision_tree(df, names, training.CLASSIFICATION, 2, max_depth=1).forest
    assert seen and sum(seen) <= 2 and 1233.5 <= forest.threshold[0] < 1234.5


@pytest.mark.parametrize("name", ["Random Forest", "Extra Trees", "Gradient Boosting", "Decision Tree"])
def test_candidates_look_at_all_values(spark, monkeypatch, name):
    """Classes that change at two neighbouring values out of 3000."""
    monkeypatch.setattr(models, "TREES", 10)
    monkeypatch.setattr(models, "BOOST_ROUNDS", 8)
    x = np.c_[np.arange(3000) / 7, np.arange(3000) % 3]
    y = (np.arange(3000) >= 1711).astype(int)
    names, df = frame(spark, x, y)
    raw = df.select("k", *names, F.when(F.col("label") == 1, "hi").otherwise("lo").alias("y"))
    run = leaderboard.automl(raw, "y", ["k"], names=[name])
    assert run.leaderboard.first()["status"] == "success"
    wrong = run.best.predict(run.train).where("label != prediction").count()
    assert wrong == 0


def test_bins_of_all_values(spark):
    df = spark.range(6000).select((F.col("id") % 900).cast("double").alias("some"), F.col("id").cast("double").alias("all"))
    (some, all_), whole = bins.feature_bins(df, df.columns, few=bins.COUNTED)
    assert len(some) == 899 and whole.tolist() == [True, False] and len(all_) < bins.BINS
    assert bins.feature_bins(df, df.columns)[1].tolist() == [False, False]


@pytest.mark.parametrize("task, kind", [(training.CLASSIFICATION, GBTClassifier), (training.REGRESSION, GBTRegressor)])
def test_boosting_as_mllib(spark, task, kind):
    x, y, v = fine_table(3)
    x = np.stack([np.floor(x[:, 0] / 150), x[:, 1], np.round(x[:, 2])], axis=1).clip(-9, 9)
    names, df = frame(spark, x, y if task == training.CLASSIFICATION else v)
    ours = forests.boosted(df, names, task, rounds=12).predict(df).select("k", F.col("prediction").alias("p"))
    assembled = VectorAssembler(inputCols=names, outputCol="f").transform(df)
    mllib = kind(maxIter=12, stepSize=0.1, maxDepth=3, maxBins=64, seed=1, featuresCol="f", labelCol="label").fit(assembled).transform(assembled)
    apart = ours.join(mllib, "k").agg(F.avg((F.abs(F.col("p") - F.col("prediction")) > 1e-6).cast("double"))).first()[0]
    assert apart < 0.01  # splits of equal gain may differ


# -- forests larger than the driver holds -----------------------------------------------


def of_kind(kind, df, names, task, trees):
    make = forests.extra_trees if kind == "extra" else forests.random_forest
    return make(df, names, task, 3 if task == training.CLASSIFICATION else 0, trees=trees)


@pytest.mark.parametrize("kind", ["extra", "bagged"])
@pytest.mark.parametrize("task", [training.CLASSIFICATION, training.REGRESSION])
def test_large_forests_are_whole(spark, monkeypatch, kind, task):
    """Nodes beyond ``MAX_NODES`` are grown all the same: to the end, as those that the driver grows."""
    x, y = table_of(4)
    y = y if task == training.CLASSIFICATION else x[:, 0] * 3 + x[:, 1]
    names, df = frame(spark, x, y)
    small = of_kind(kind, df, names, task, 8)
    monkeypatch.setattr(forests, "MAX_NODES", 50)
    monkeypatch.setattr(subtrees, "CHUNK_ROWS", 300)
    monkeypatch.setattr(splits, "DEALT_NUMBERS", 10_000)
    large = of_kind(kind, df, names, task, 8)
    assert small.subtrees is None and len(large.forest.feature) <= 50 and large.subtrees.count() > 200
    nodes = len(large.forest.feature) - large.subtrees.select("node").distinct().count() + large.subtrees.count()
    assert 0.7 * len(small.forest.feature) < nodes < 1.4 * len(small.forest.feature)
    found = {r["k"]: r for r in large.predict(df).collect()}
    assert len(found) == len(y) and "plumbline total" not in large.predict(df).columns
    got = np.array([found[f"r{i:04d}"]["prediction"] for i in range(len(y))])
    if task == training.CLASSIFICATION:
        assert (got == y).mean() == 1 if kind == "extra" else (got == y).mean() > 0.95
        assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in found.values())
    else:
        assert np.abs(got - y).max() < 1e-6 if kind == "extra" else np.abs(got - y).mean() < 0.5
    a, b = small.importances(), large.importances()
    assert sum(b.values()) == pytest.approx(1) and all(abs(a[f] - b[f]) < 0.15 for f in names)
    with pytest.raises(ValueError, match="predict"):
        large.scores(x)


def test_subtrees_are_grafted_where_they_fit(spark, monkeypatch):
    x, y = table_of(5)
    names, df = frame(spark, x, y)
    monkeypatch.setattr(splits, "DEEP_LEVELS", 3)
    for kind in ("extra", "bagged"):
        model = of_kind(kind, df, names, training.CLASSIFICATION, 6)
        forest = model.forest
        assert model.subtrees is None and not (forest.feature == subtrees.GOES_ON).any()
        if kind == "extra":
            leaves = forest.leaves(x)
            assert (forest.value[leaves].max(axis=2) == 1).all()
            assert (forest._trees() >= 0).all()
        found = {r["k"]: r["prediction"] for r in model.predict(df).collect()}
        assert np.mean([found[f"r{i:04d}"] == t for i, t in enumerate(y)]) > 0.95


@pytest.mark.parametrize("kind", ["extra", "bagged"])
@pytest.mark.parametrize("task", [training.CLASSIFICATION, training.REGRESSION])
def test_passes_grow_as_tasks_do(spark, monkeypatch, kind, task):
    x, y = table_of(6)
    y = y if task == training.CLASSIFICATION else x[:, 0] * 3 + x[:, 1]
    names, df = frame(spark, x, y)
    tasks = of_kind(kind, df, names, task, 8)
    monkeypatch.setattr(splits, "FINISHED_ROWS", 0)  # nothing is left to tasks
    monkeypatch.setattr(forests, "FEW_VALUES", 32)
    monkeypatch.setattr(subtrees, "finish", None)
    passes = of_kind(kind, df, names, task, 8)
    assert 0.7 * len(tasks.forest.feature) < len(passes.forest.feature) < 1.4 * len(tasks.forest.feature)
    for model in (tasks, passes):
        got = model.scores(x)
        if task == training.CLASSIFICATION:
            assert (got.argmax(axis=1) == y).mean() > (0.999 if kind == "extra" else 0.95)
        else:
            assert np.abs(got[:, 0] - y).max() < 1e-6 if kind == "extra" else np.abs(got[:, 0] - y).mean() < 0.5


def test_kept_large_forest_predicts_alike(spark, monkeypatch):
    monkeypatch.setattr(models, "TREES", 4)
    monkeypatch.setattr(forests, "MAX_NODES", 40)
    x, y = table_of(7)
    names, df = frame(spark, x, y)
    raw = df.withColumn("y", F.concat(F.lit("c"), F.col("label").cast("int").cast("string"))).drop("label")
    run = leaderboard.automl(raw, "y", ["k"], names=["Extra Trees"])
    assert run.leaderboard.first()["status"] == "success" and run.best.trees.subtrees is not None
    path = scratch_path(spark, "kept")
    leaderboard.save(run, path)
    got = {r["k"]: r["prediction"] for r in leaderboard.load_model(spark, path).predict(raw).collect()}
    want = {r["k"]: r["prediction"] for r in run.best.predict(run.test).collect()}
    assert want and all(got[k] == v for k, v in want.items())


def test_forests_grow_to_the_end(spark):
    """A chain of splits longer than any fixed depth: every value is twice the one before."""
    x = 2.0 ** np.arange(60)[:, None]
    y = np.arange(60) % 2
    names, df = frame(spark, x, y)
    model = forests.extra_trees(df, names, training.CLASSIFICATION, 2, trees=2)
    assert (model.scores(x).argmax(axis=1) == y).all()


def test_constant_tries_are_drawn_again(spark):
    """One feature out of nine varies: every node finds it."""
    x = np.c_[np.ones((200, 8)), np.arange(200)]
    names, df = frame(spark, x, (np.arange(200) // 10) % 2)
    forest = forests.random_forest(df, names, training.CLASSIFICATION, 2, trees=5).forest
    assert (forest.feature[forest.roots] == 8).all()
    assert (forest.value[forest.feature < 0].max(axis=1) == 1).all()
