"""Properties of the learned operators."""

import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import queries
from catalog.fixtures import table
from plumbline.functions.frames import scratch_path
from plumbline.operators import anomaly, explain, leaderboard, models, neighbours, profile, training
from plumbline.plans import codes, tiles


@pytest.fixture(scope="module")
def ml(spark, sf_dir):
    return table(spark, sf_dir, "fx_ml")


@pytest.fixture(scope="module")
def classes(ml):
    return training.prepare_features(ml.drop("y_num"), "y_txt", ["k"])


@pytest.fixture(scope="module")
def numbers(ml):
    return training.prepare_features(ml.drop("y_txt"), "y_num", ["k"])


# -- nearest neighbours ---------------------------------------------------


def brute(train, query, k):
    order = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(query, x))), i, y) for i, x, y in train)
    return [(pytest.approx(d, rel=1e-12), y) for d, _, y in order[:k]]


@pytest.mark.parametrize("shape", ["spread", "clumped", "copies", "few"])
def test_neighbours_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    if shape == "spread":
        points = rng.normal(size=(300, 4)) * [100, 10, 1, 5]
    elif shape == "clumped":  # one dense clump, far outliers
        points = np.concatenate([rng.normal(size=(280, 4)) * 1e-3, rng.normal(size=(20, 4)) * 1e6])
    elif shape == "copies":  # a third of the rows are one vector
        points = np.concatenate([np.zeros((100, 4)), rng.integers(0, 3, (200, 4))]).astype(float)
    else:
        points = rng.normal(size=(3, 4))
    names = ["a", "b", "c", "d"]
    train = [(f"k{i:04d}", tuple(map(float, p)), float(i % 3)) for i, p in enumerate(points)]
    queries = np.concatenate([points[:15], rng.normal(size=(15, 4)) * 50, [[1e7, 0, 0, 0]]])
    rows = spark.createDataFrame([(i, *x, y) for i, x, y in train], "k string, a double, b double, c double, d double, label double")
    asked = spark.createDataFrame([(f"q{i}", *map(float, q)) for i, q in enumerate(queries)], "k string, a double, b double, c double, d double")
    found = {}
    for r in neighbours.nearest(rows, asked, names, ["k"], 5).orderBy("x", "rank").collect():
        found.setdefault(tuple(r["x"]), []).append((r["dist"], r["label"]))
    assert len(found) == len({tuple(map(float, q)) for q in queries})
    for q, got in found.items():
        assert got == brute(train, q, 5)


def test_neighbours_meet_few_rows(spark, monkeypatch):
    """Twelve features in clusters: far fewer pairs are compared than queries times rows."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 10, (40, 12))
    points = centres[rng.integers(0, 40, 2300)] + rng.normal(0, 1, (2300, 12))
    names = [f"f{i}" for i in range(12)]
    rows = [(f"r{i:04d}", float(i % 2), *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "k string, label double, " + ", ".join(f"{n} double" for n in names))
    train, asked = df.where("k < 'r2000'"), df.where("k >= 'r2000'")
    compared = []
    plain = tiles.cell_sizes

    def counted(a, b):
        sizes = plain(a, b)
        compared.append(sizes.agg(F.sum(F.col("queries") * F.col("rows"))).first()[0] or 0)
        return sizes

    monkeypatch.setattr(tiles, "cell_sizes", counted)
    found = {}
    for r in neighbours.nearest(train, asked, names, ["k"], 5).orderBy("x", "rank").collect():
        found.setdefault(tuple(r["x"]), []).append(r["dist"])
    for q in points[2000:2020]:
        want = np.sort(np.sqrt(((points[:2000] - q) ** 2).sum(axis=1)))[:5]
        assert np.allclose(found[tuple(map(float, q))], want)
    assert sum(compared) < 0.1 * 300 * 2000


@pytest.mark.parametrize("dims", [3, 16])
def test_hashed_neighbours(spark, monkeypatch, dims):
    """Recall of at least 0.9 against brute force, with far fewer compared pairs than queries times rows; hot buckets in many tiles."""
    monkeypatch.setattr(tiles, "TILE_QUERIES", 50)
    monkeypatch.setattr(tiles, "TILE_ROWS", 60)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (60, dims))
    points = centres[rng.integers(0, 60, 8400)] + rng.normal(0, 1, (8400, dims))
    points[:900] = centres[0] + rng.normal(0, 0.01, (900, dims))  # a dense clump
    names = [f"f{i}" for i in range(dims)]
    rows = [(f"r{i:04d}", float(i % 2), *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "k string, label double, " + ", ".join(f"{n} double" for n in names))
    train, asked = df.where("k < 'r8000'"), df.where("k >= 'r8000'")
    compared, plain = [], tiles.cell_sizes

    def counted(a, b):
        sizes = plain(a, b)
        compared.append(sizes.agg(F.sum(F.col("queries") * F.col("rows"))).first()[0] or 0)
        return sizes

    monkeypatch.setattr(tiles, "cell_sizes", counted)
    found = {}
    for r in neighbours.nearest_hashed(train, asked, names, ["k"], 5, tables=3, bucket_rows=16, probes=2).orderBy("x", "rank").collect():
        found.setdefault(tuple(r["x"]), []).append(r["dist"])
    hits = 0
    for q in points[8000:]:
        want = np.sort(np.sqrt(((points[:8000] - q) ** 2).sum(axis=1)))[:5]
        got = np.array(found[tuple(map(float, q))])
        assert len(got) == 5
        hits += int((got <= want[-1] * (1 + 1e-9)).sum())
    assert hits >= 0.9 * 5 * 400
    assert sum(compared) < 0.4 * 400 * 8000


def test_hashed_neighbours_complete(spark):
    """Too few rows in a bucket, one row in all, copies, constant features: every query gets its k as in the exact form."""
    rows = spark.createDataFrame([(f"k{i}", 1.0, float(i % 7) * 100, float(i % 2)) for i in range(40)], "k string, c double, a double, label double")
    asked = spark.createDataFrame([("q", 1.0, 50.0), ("r", 1.0, -1e9), ("s", 2.0, 0.0)], "k string, c double, a double")
    for size, k in ((1, 5), (4, 60), (64, 3)):
        got = neighbours.nearest_hashed(rows, asked, ["c", "a"], ["k"], k, tables=1, bucket_rows=size, probes=0)
        want = neighbours.nearest(rows, asked, ["c", "a"], ["k"], k)
        counts = lambda df: {tuple(r["x"]): r["n"] for r in df.groupBy("x").agg(F.count("*").alias("n")).collect()}
        assert counts(got) == counts(want)
    one = neighbours.knn_predict(rows.limit(1), asked, ["c", "a"], ["k"], training.REGRESSION, 3, search=neighbours.nearest_hashed)
    assert {r["prediction"] for r in one.collect()} == {0.0}


def test_neighbours_vote(spark, classes):
    train, test = leaderboard.split(classes, 0.2)
    found = neighbours.knn_predict(train, test, classes.names, ["k"], classes.task)
    assert found.count() == test.count()
    assert found.where("prediction IS NULL").count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(train, test, classes.names, ["k"], 0)


# -- isolation forest -----------------------------------------------------


def test_forest_flags_the_top_share_and_repeats(spark, sf_dir):
    df = table(spark, sf_dir, "fx_outlier")
    first = anomaly.iforest_scores(df, ["id"])
    rows = first.collect()
    assert sum(r["is_anomaly"] for r in rows) / len(rows) == pytest.approx(0.05, abs=0.01)
    low = min(r["anomaly_score"] for r in rows if r["is_anomaly"])
    high = max(r["anomaly_score"] for r in rows if not r["is_anomaly"])
    assert low >= 0 >= high
    again = anomaly.iforest_scores(df.repartition(5), ["id"]).collect()
    assert {(r["id"], r["anomaly_score"]) for r in rows} == {(r["id"], r["anomaly_score"]) for r in again}


def test_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(400, 30.0, -30.0)]
    scores = anomaly.iforest_scores(spark.createDataFrame(rows, "id int, a double, b double"), ["id"])
    assert scores.orderBy(F.desc("anomaly_score")).first()["id"] == 400


def test_tree_shape(spark, sf_dir):
    nodes = anomaly.iforest_trees(table(spark, sf_dir, "fx_outlier"), ["id"]).toPandas()
    for _, t in nodes.groupby("tree"):
        leaves = t[t["feature"] < 0]
        assert leaves["size"].sum() == 256 and t["depth"].max() <= 8 and len(t) <= 511


# -- normality ------------------------------------------------------------


def test_shapiro_on_known_samples():
    # published example: weights of 11 men (Shapiro and Wilk 1965), W = 0.79, p = 0.0067
    men = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float)
    assert profile.shapiro_p(men) == pytest.approx(0.0067, abs=3e-4)
    rng = np.random.default_rng(1)
    assert profile.shapiro_p(rng.normal(size=300)) > 0.05
    assert profile.shapiro_p(rng.exponential(size=300)) < 1e-6


def test_shapiro_skips_small_and_large(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i < 4 else None, float(i)) for i in range(30)], "k int, few double, many double")
    found = {r["column"]: r["p_value"] for r in profile.normality_shapiro(df, ["k"], limit=29).collect()}
    assert found == {"k": None, "few": None, "many": None}


def test_shapiro_with_a_repeated_key(spark):
    rng = np.random.default_rng(5)
    rows = [("abc"[i % 3] if i % 4 else None, float(x)) for i, x in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "k string, v double")
    assert profile.normality_shapiro(df, ["k"]).first()["p_value"] is not None


# -- models ---------------------------------------------------------------


def test_task_rules(spark):
    rows = [(i, i % 14, float(i % 12), float(i % 9), str(i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, whole int, twelve double, nine double, text string, many double")
    names = ["whole", "twelve", "nine", "text", "many"]
    c, r = training.CLASSIFICATION, training.REGRESSION
    assert [x["task"] for x in training.task_frame(df, names, training.task_single).collect()] == [c, r, c, c, r]
    assert [x["task"] for x in training.task_frame(df, names, training.task_automl).collect()] == [c, c, c, c, r]


def test_split_is_stable(classes):
    train, test = leaderboard.split(classes, 0.3)
    assert test.count() / (train.count() + test.count()) == pytest.approx(0.3, abs=0.05)
    assert test.join(train, "k", "left_semi").count() == 0


def test_ridge_and_lasso_closed_form(spark, numbers):
    train, _ = leaderboard.split(numbers, 0.2)
    pdf = train.toPandas()
    x, y = pdf[numbers.names].to_numpy(), pdf["label"].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    found = models.fit("Ridge", numbers, train).pipeline.stages[-1].coefficients.toArray()
    assert found == pytest.approx(want, rel=1e-6)


def test_leaderboard_ranks_and_survives_a_failure(spark, numbers, tmp_path):
    def fit(name, features, train):
        if name == "Broken":
            raise RuntimeError("no such luck")
        return models.fit(name, features, train)

    run = leaderboard.train_candidates(numbers, names=["Decision Tree", "Broken", "Ridge", "Lasso"], fit=fit)
    rows = run.leaderboard.orderBy("rank").collect()
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert (rows[-1]["model"], rows[-1]["status"], rows[-1]["score"], rows[-1]["error"]) == ("Broken", "failed", -999.0, "no such luck")
    assert run.best.name == rows[0]["model"] and rows[0]["is_best"]
    summary = run.summary().first()
    assert (summary["n_models_trained"], summary["n_models_failed"]) == (3, 1)
    path = scratch_path(spark, "board")
    with pytest.raises(FileNotFoundError):
        leaderboard.load_leaderboard(spark, path)
    leaderboard.save(run, path)
    assert leaderboard.load_leaderboard(spark, path).count() == 4
    loaded = leaderboard.load_model(spark, path)
    assert loaded.name == run.best.name
    again = {r["k"]: r["prediction"] for r in loaded.score(run.test).collect()}
    assert again == {r["k"]: r["prediction"] for r in run.best.predict(run.test).collect()}


def test_last_run_wins_and_neighbours_can_be_read_back(spark, sf_dir, classes, numbers):
    raw = table(spark, sf_dir, "fx_ml")
    path = scratch_path(spark, "board")
    leaderboard.save(leaderboard.train_candidates(numbers, names=["Ridge"]), path)
    run = leaderboard.train_candidates(classes, names=["KNN"])
    leaderboard.save(run, path)
    loaded = leaderboard.load_model(spark, path)
    assert loaded.name == "KNN"
    few = raw.join(run.test.select("k").orderBy("k").limit(20), "k", "left_semi")
    predicted = {r["k"]: r["prediction"] for r in loaded.predict(few).collect()}
    assert len(predicted) == 20 and predicted == {r["k"]: r["prediction"] for r in run.best.predict(run.test).collect() if r["k"] in predicted}
    leaderboard.save(leaderboard.train_candidates(numbers, names=["Nothing"]), path)
    with pytest.raises(FileNotFoundError):
        leaderboard.load_model(spark, path)


def test_raw_rows_are_prepared_like_the_training_rows(spark, sf_dir, classes):
    raw = table(spark, sf_dir, "fx_ml").where("k IS NOT NULL")
    ready = classes.preparation.apply(raw, ["k"])
    assert {tuple(r) for r in ready.collect()} == {tuple(r) for r in classes.df.select("k", *classes.names).collect()}
    odd = raw.limit(1).withColumn("flag", F.lit("never seen")).withColumn("d", F.lit(None).cast("double"))
    row = classes.preparation.apply(odd, ["k"]).first()
    assert row["flag"] == 3.0 and row["d"] is not None


def test_more_than_a_hundred_classes(spark):
    rows = [(i, f"c{i % 120:03d}", float(i % 120), float(i % 7)) for i in range(1200)]
    df = spark.createDataFrame(rows, "k int, y string, a double, b double")
    run = leaderboard.train_candidates(training.prepare_features(df, "y", ["k"]), names=["Decision Tree", "KNN"])
    assert {r["status"] for r in run.leaderboard.collect()} == {"success"}
    many = spark.createDataFrame([(i, f"c{i % 1500:04d}", float(i)) for i in range(3000)], "k int, y string, a double")
    labelled, names = training.prepare_target(many, "y", training.CLASSIFICATION)
    assert len(names) == 1500 and labelled.agg(F.max("label")).first()[0] == 1499.0


def test_classes_are_numbered_without_the_driver(spark, monkeypatch):
    """Beyond the limit, values are numbered in range buckets; names come only when they are asked for."""
    monkeypatch.setattr(codes, "CODE_LIMIT", 1000)
    df = spark.range(60_000).select("id", (F.col("id") * 7919 % 30_011).cast("double").alias("n"), F.format_string("v%05d", F.col("id") % 20_000).alias("t"))
    for target, size in (("n", 30_011), ("t", 20_000)):
        rows, names = training.prepare_target(df, target, training.CLASSIFICATION)
        assert len(names) == size and names._names is None
        got = rows.agg(F.min("label"), F.max("label"), F.count_distinct("label"), F.count("*")).first()
        assert tuple(got) == (0.0, size - 1.0, size, 60_000)
        assert rows.where("n != label").isEmpty() if target == "n" else names[5] == "v00005"
    rows, names = training.prepare_target(df.where("id < 3"), "t", training.CLASSIFICATION)
    assert names == ["v00000", "v00001", "v00002"]


def test_report_of_a_regression_and_of_nothing(numbers):
    run = leaderboard.train_candidates(numbers, names=["Ridge"])
    assert leaderboard.report(run).columns == ["rmse", "mae", "r2_score"]
    with pytest.raises(ValueError, match="no candidate"):
        leaderboard.report(leaderboard.train_candidates(numbers, names=["Nothing"]))


def test_all_failures_have_no_best(numbers):
    run = leaderboard.train_candidates(numbers, names=["Nothing"])
    assert run.best is None and not run.leaderboard.first()["is_best"]


def test_many_classes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(models, "BOOST_ROUNDS", 4)
    df = table(spark, sf_dir, "fx_ml").select("k", "q", "d", "flag")
    features = training.prepare_features(df, "flag", ["k"])
    assert features.classes == ["A", "N", "R"]
    run = leaderboard.train_candidates(features, names=["Decision Tree", "Gradient Boosting", "Logistic Regression", "KNN"])
    assert run.leaderboard.where("status = 'success'").count() == 4
    assert {"A", "N", "R", "accuracy", "macro avg", "weighted avg"} >= {r["class"] for r in leaderboard.report(run).collect()}


def test_targets_are_fitted_side_by_side(spark, sf_dir, monkeypatch):
    """Neither fit waits for the other's rounds; the rows keep the order of the targets."""
    monkeypatch.setattr(models, "BOOST_ROUNDS", 2)
    both, plain = threading.Barrier(2, timeout=120), models.gradient_boosting

    def meet(features, train):
        both.wait()
        return plain(features, train)

    monkeypatch.setitem(models.CLASSIFIERS, "Gradient Boosting", meet)
    monkeypatch.setitem(models.REGRESSORS, "Gradient Boosting", meet)
    monkeypatch.setattr(models, "gradient_boosting", meet)
    found = queries.build()["model_gbt"](spark, sf_dir).collect()
    assert [(r["target"], r["status"]) for r in found] == [("y_txt", "success"), ("y_num", "success")]


def test_importances_add_up(classes):
    train, _ = leaderboard.split(classes, 0.2)
    fitted = models.fit("Decision Tree", classes, train)
    assert sum(fitted.importances.values()) == pytest.approx(1.0)


# -- explanation ----------------------------------------------------------


@pytest.mark.parametrize("count", [1, 3, 8, 11, 70])
def test_contributions_add_up(spark, count):
    """At every width contributions sum to score minus mean score."""
    rng = np.random.default_rng(count)
    names = [f"f{i}" for i in range(count)]
    pdf = pd.DataFrame(rng.normal(size=(12, count)), columns=names)
    pdf.insert(0, "k", [f"r{i:02d}" for i in range(12)])
    df = spark.createDataFrame(pdf)

    def score(frame):
        total = sum((F.col(n) * F.col(m) for n, m in zip(names, names[1:] + names[:1])), F.lit(0.0))
        return frame.withColumn("outputs", F.array(total + F.col(names[0])))

    def value(x):
        return float(sum(a * b for a, b in zip(x, np.roll(x, -1))) + x[0])

    found = explain.shapley_values(df.limit(4), df, names, ["k"], score)
    sums = {r["k"]: r["s"] for r in found.groupBy("k").agg(F.sum("contribution").alias("s")).collect()}
    mean = np.mean([value(x) for x in pdf[names].to_numpy()])
    for k, total in sums.items():
        assert total == pytest.approx(value(pdf.loc[pdf["k"] == k, names].to_numpy()[0]) - mean, abs=1e-4)


def test_explaining_a_tree_and_falling_back(spark, classes):
    train, test = leaderboard.split(classes, 0.2)
    tree = models.fit("Decision Tree", classes, train)
    found = explain.explain_or_importance(tree, classes.task, test, train, classes.names, ["k"])
    assert found.where("warning IS NOT NULL").count() == 0 and found.count() == len(classes.names)
    def fails(frame):
        return tree.predict(frame).withColumn("prediction", F.raise_error(F.lit("fails while it runs")))

    late = models.Fitted("Late", fails, tree.importances, tree.pipeline)
    stand_in = explain.explain_or_importance(late, "regression", test, train, classes.names, ["k"])
    assert stand_in.where("warning LIKE '%fails while it runs%'").count() == len(classes.names)
    broken = models.Fitted("Broken", tree.predict, tree.importances)
    stand_in = explain.explain_or_importance(broken, classes.task, test, train, classes.names, ["k"])
    assert stand_in.where("warning LIKE '%no pipeline%'").count() == len(classes.names)
