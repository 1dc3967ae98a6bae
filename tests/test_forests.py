"""Extra trees and boosting of several classes, by property and against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.frames import scratch_path
from plumbline.operators import forests, leaderboard, models, training


def frame(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(f"r{i:04d}", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return names, spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names) + ", label double")


def table_of(seed, n=400, width=5):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=(n, width - 2)), rng.integers(0, 4, n), np.full(n, 7.0)]
    return x, (x[:, 0] + x[:, -2] > 1.5).astype(int) + (x[:, 1] > 0)


# -- extra trees ------------------------------------------------------------------------


def test_extra_trees_split_at_random_without_bagging(spark):
    x, y = table_of(1)
    names, df = frame(spark, x, y)
    model = forests.extra_trees(df, names, training.CLASSIFICATION, 3, trees=20)
    forest = model.forest
    roots = np.array(forest.roots)
    first = forest.feature[roots] == forest.feature[roots][0]
    assert len(set(forest.threshold[roots][first])) == first.sum()  # each tree draws its own
    # every tree has seen every row: all leaves are pure, and the root holds the shares of the whole
    assert np.allclose(forest.value[roots], np.bincount(y) / len(y))
    leaves = forest.leaves(x)
    for t in range(20):
        assert (forest.value[leaves[:, t]].max(axis=1) == 1).all()
    assert not (forest.feature == 4).any()  # a constant has nothing to split
    found = {r["k"]: r for r in model.predict(df).collect()}
    assert [found[f"r{i:04d}"]["prediction"] for i in range(len(y))] == y.tolist()
    assert math.isclose(sum(model.importances().values()), 1)


def test_extra_trees_thresholds_lie_within_their_node(spark):
    x, y = table_of(2)
    names, df = frame(spark, x, y)
    forest = forests.extra_trees(df, names, training.CLASSIFICATION, 3, trees=5).forest
    for root in forest.roots:
        inside = {root: np.arange(len(x))}
        for node in range(root, len(forest.feature)):
            if node in inside and forest.feature[node] >= 0:
                mine = x[inside[node], forest.feature[node]]
                low = mine <= forest.threshold[node]
                assert low.any() and not low.all()  # no split leaves a side empty
                inside[forest.left[node]], inside[forest.left[node] + 1] = inside[node][low], inside[node][~low]


def test_extra_trees_numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (500, 2))
    y = 1e6 + 10 * x[:, 0]
    names, df = frame(spark, x, y)
    model = forests.extra_trees(df.where("k < 'r0400'"), names, training.REGRESSION, 0, trees=30)
    row = training.metrics_regression(model.predict(df.where("k >= 'r0400'"))).first()
    assert row["r2_score"] > 0.98
    assert model.importances()["f0"] > 0.9
    # grown to the end, a forest without bagging repeats its training rows
    assert training.metrics_regression(model.predict(df.where("k < 'r0400'"))).first()["rmse"] < 1e-3


def test_extra_trees_bounds(spark, monkeypatch):
    x, y = table_of(4)
    names, df = frame(spark, x, y)
    stump = forests.extra_trees(df, names, training.CLASSIFICATION, 3, trees=4, max_depth=1).forest
    assert len(stump.feature) == 12
    monkeypatch.setattr(forests, "MAX_NODES", 50)
    assert len(forests.extra_trees(df, names, training.CLASSIFICATION, 3, trees=4).forest.feature) <= 50
    flat = forests.extra_trees(df.withColumn("f0", F.lit(1.0)), ["f0"], training.CLASSIFICATION, 3, trees=2)
    assert np.allclose(flat.scores(np.ones((1, 1))), np.bincount(y) / len(y)) and set(flat.importances().values()) == {0.0}


def test_equal_rows_weigh_as_many(spark):
    x, y = np.array([[0.0], [0.0], [0.0], [1.0]]), np.array([0, 0, 1, 1])
    names, df = frame(spark, x, y)
    many = df.unionByName(df).unionByName(df)
    a, b = (forests.extra_trees(d, names, training.CLASSIFICATION, 2, trees=3).scores(np.array([[0.0], [1.0]])) for d in (df, many))
    assert np.allclose(a, b) and np.allclose(a, [[2 / 3, 1 / 3], [0, 1]])


# -- boosting ---------------------------------------------------------------------------


def log_loss(model, x, y, rounds):
    scores = model.forest.total(x, model.forest.roots[: rounds * model.classes]) + model.start
    return -np.log(forests.softmax(scores)[np.arange(len(y)), y]).mean()


def test_log_loss_falls_every_round(spark):
    x, y = table_of(5)
    names, df = frame(spark, x, y)
    model = forests.boosted_classes(df, names, 3, rounds=14)
    assert len(model.forest.roots) == 42
    losses = [log_loss(model, x, y, r) for r in range(15)]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    found = model.predict(df).collect()
    assert all(math.isclose(sum(r["probability"]), 1, abs_tol=1e-9) for r in found)
    assert sum(r["prediction"] == r["label"] for r in found) > 0.85 * len(found)


def plain_boosting(x, y, classes, rounds, step, depth):
    """One row at a time, every value a threshold."""
    scores = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))

    def grow(rows, r, level):
        g, h = r[rows].sum(), (np.abs(r[rows]) * (1 - np.abs(r[rows]))).sum()
        best = (1e-12, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    low = x[rows, f] <= cut
                    a, b = r[rows][low], r[rows][~low]
                    gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - g**2 / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, low)
        if best[1] is None:
            out = np.zeros(len(y))
            out[rows] = step * (classes - 1) / classes * g / h
            return out
        return grow(rows[best[1]], r, level + 1) + grow(rows[~best[1]], r, level + 1)

    for _ in range(rounds):
        p = forests.softmax(scores)
        scores = scores + np.stack([grow(np.arange(len(y)), (y == k) - p[:, k], 0) for k in range(classes)], axis=1)
    return scores


def test_boosting_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(forests, "KEPT_ROUNDS", 2)
    rng = np.random.default_rng(6)
    x = np.stack([rng.permutation(np.arange(200) % 11), rng.permutation(np.arange(200) % 7)], axis=1).astype(float)
    y = ((x[:, 0] > 4).astype(int) + (x[:, 1] + rng.normal(0, 1, 200) > 3)).astype(int)
    names, df = frame(spark, x, y)
    model = forests.boosted_classes(df, names, 3, rounds=5, depth=2)
    want = plain_boosting(x, y, 3, 5, 0.1, 2)
    assert np.allclose(model.forest.total(x) + model.start, want, atol=1e-9)


# -- keeping ----------------------------------------------------------------------------


@pytest.mark.parametrize("name, classes", [("Extra Trees", 2), ("Gradient Boosting", 3), ("Extra Trees", 0)])
def test_kept_tree_models_predict_alike(spark, monkeypatch, name, classes):
    monkeypatch.setattr(models, "BOOST_ROUNDS", 3)
    monkeypatch.setattr(models, "TREES", 4)
    x, y = table_of(7)
    names, df = frame(spark, x, y % classes if classes else x[:, 0] * 2)
    raw = df.withColumn("y", F.concat(F.lit("c"), F.col("label").cast("int").cast("string")) if classes else F.col("label")).drop("label")
    run = leaderboard.automl(raw, "y", ["k"], names=[name])
    assert run.leaderboard.first()["status"] == "success"
    path = scratch_path(spark, "kept")
    leaderboard.save(run, path)
    leaderboard.save(run, path)  # a second run beside the first
    loaded = leaderboard.load_model(spark, path)
    got = {r["k"]: r["prediction"] for r in loaded.predict(raw).collect()}
    want = {r["k"]: r["prediction"] for r in run.best.predict(run.test).collect()}
    assert want and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
