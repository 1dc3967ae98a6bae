"""Training all candidates side by side and ranking them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import deal_out, materialise, small_frame
from plumbline.operators import forests, models
from plumbline.operators.neighbours import knn_predict
from plumbline.operators.training import (
    CLASSIFICATION, Features, Preparation, classification_report, metrics_classification, metrics_regression, prepare_features,
    task_automl, task_single, test_flag,
)

WORKERS = 4
TEST = "plumbline test row"
FAILED_SCORE = -999.0
ROWS = (
    "model string, status string, score double, accuracy double, f1_score double, rmse double, mae double, "
    "r2_score double, train_time_sec double, error string"
)


@dataclass
class Trained:
    """Result of a training run."""

    task: str
    features: Features
    leaderboard: DataFrame
    best: models.Fitted | None
    n_train: int
    n_test: int
    train: DataFrame
    test: DataFrame

    def summary(self) -> DataFrame:
        """Best model, counts of trained and failed candidates, and split sizes."""
        return self.leaderboard.agg(
            F.lit(self.task).alias("task"),
            F.max(F.when(F.col("is_best"), F.col("model"))).alias("best_model"),
            F.count_if(F.col("status") == "success").alias("n_models_trained"),
            F.count_if(F.col("status") == "failed").alias("n_models_failed"),
            F.lit(self.n_train).alias("n_train"), F.lit(self.n_test).alias("n_test"),
        )


def rank(rows: DataFrame) -> DataFrame:
    """Rank by score, failures last; names settle ties. The best is the first success."""
    order = Window.orderBy(F.desc("score"), "model")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    first = F.min(F.when(F.col("status") == "success", F.col("rank"))).over(Window.partitionBy())
    return ranked.withColumn("is_best", F.coalesce(F.col("rank") == first, F.lit(False)))


def _metrics(features: Features, fitted: models.Fitted, test: DataFrame) -> dict:
    predictions = fitted.predict(test)
    if features.task == CLASSIFICATION:
        return metrics_classification(predictions).first().asDict()
    return metrics_regression(predictions).first().asDict()


def _attempt(name: str, fit: Callable, features: Features, train: DataFrame, test: DataFrame) -> tuple[dict, models.Fitted | None]:
    start = time.time()
    try:
        fitted = fit(name, features, train)
        metrics = _metrics(features, fitted, test)
        score = metrics["accuracy" if features.task == CLASSIFICATION else "r2_score"]
        return {"model": name, "status": "success", "score": score, "train_time_sec": round(time.time() - start, 3), **metrics}, fitted
    except Exception as failure:  # one failed candidate must not lose the others
        row = {"model": name, "status": "failed", "score": FAILED_SCORE, "train_time_sec": 0.0, "error": str(failure).split("\n")[0]}
        return row, None


def split(features: Features, test_size: float) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, prepared once and written, so that a lost
    executor costs no candidate more than rereading its share."""
    rows = deal_out(features.df, features.key)
    rows = materialise(rows.withColumn(TEST, test_flag(features.key, test_size)), "features")
    return rows.where(~col(TEST)).drop(TEST), rows.where(col(TEST)).drop(TEST)


def train_candidates(features: Features, test_size: float = 0.2, names: list[str] | None = None, fit: Callable = models.fit_whole) -> Trained:
    """Train the candidates four at a time; Spark interleaves their jobs."""
    train, test = split(features, test_size)
    n_train, n_test = train.count(), test.count()
    names = list(models.candidates(features.task)) if names is None else names
    with ThreadPoolExecutor(WORKERS) as pool:
        attempt = inheritable_thread_target(features.df.sparkSession)(_attempt)
        results = list(pool.map(lambda n: attempt(n, fit, features, train, test), names))
    spark = features.df.sparkSession
    board = rank(small_frame(spark, [row for row, _ in results], ROWS))
    top = board.where("is_best").first()
    best = next((f for _, f in results if f is not None and top is not None and f.name == top["model"]), None)
    return Trained(features.task, features, board, best, n_train, n_test, train, test)


def automl(df: DataFrame, target: str, key: list[str], task: str = "auto", test_size: float = 0.2, names: list[str] | None = None) -> Trained:
    """Leaderboard of every candidate for a target."""
    return train_candidates(prepare_features(df, target, key, task, task_automl), test_size, names)


def train_model(df: DataFrame, target: str, key: list[str], task: str = "auto", test_size: float = 0.2) -> Trained:
    """One random forest, with the task rule of the single-model path."""
    return train_candidates(prepare_features(df, target, key, task, task_single), test_size, ["Random Forest"])


def report(trained: Trained) -> DataFrame:
    """Per-class report of the best model with class names; of a regression, its errors.

    A run without a successful candidate has nothing to report on.
    """
    if trained.best is None:
        raise ValueError("no candidate was trained successfully")
    predictions = trained.best.predict(trained.test)
    if trained.task != CLASSIFICATION:
        return metrics_regression(predictions)
    names = small_frame(
        trained.leaderboard.sparkSession,
        [{"class": str(float(i)), "name": n} for i, n in enumerate(trained.features.classes)], "class string, name string",
    )
    rows = classification_report(predictions)
    return rows.join(F.broadcast(names), "class", "left").withColumn("class", F.coalesce("name", "class")).drop("name")


# -- keeping a run --------------------------------------------------------


MANIFEST = (
    "run string, task string, model string, target string, names array<string>, key array<string>, classes array<string>, text array<string>, "
    "kind string, saved bigint"
)


def save(trained: Trained, path: str) -> None:
    """Write the leaderboard, the best model and how its rows were prepared.

    Every run gets a folder of its own, its manifest among the manifests last.
    Nothing is overwritten: a reader takes the newest run whose manifest is there,
    so it never meets half a run, and runs may be saved at the same time.
    """
    features, spark = trained.features, trained.leaderboard.sparkSession
    run = uuid.uuid4().hex
    trained.leaderboard.write.parquet(f"{path}/runs/{run}/leaderboard")
    model = None
    if trained.best is not None:
        model = trained.best.name
        if trained.best.pipeline is not None:
            trained.best.pipeline.write().save(f"{path}/runs/{run}/model")
        elif trained.best.trees is not None:
            trained.best.trees.frame(spark).write.parquet(f"{path}/runs/{run}/trees")
            if trained.best.trees.subtrees is not None:
                trained.best.trees.subtrees.write.parquet(f"{path}/runs/{run}/subtrees")
        else:
            trained.train.write.parquet(f"{path}/runs/{run}/neighbours")
        prepared = features.preparation
        if prepared is not None:
            prepared.fills.write.parquet(f"{path}/runs/{run}/fills")
            prepared.codes.write.parquet(f"{path}/runs/{run}/codes")
    row = {
        "run": run, "task": trained.task, "model": model, "target": features.target, "names": features.names, "key": features.key, "classes": list(features.classes) if features.classes is not None else None,
        "text": features.preparation.text if features.preparation else None, "kind": _kind(trained.best), "saved": time.time_ns(),
    }
    small_frame(spark, [row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")


def _kind(best: models.Fitted | None) -> str | None:
    if best is None:
        return None
    if best.pipeline is not None:
        return "pipeline"
    if best.trees is not None:
        return "trees" if best.trees.subtrees is None else "trees and subtrees"
    return "neighbours"


def _manifest(spark: SparkSession, path: str):
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifests").orderBy(F.desc("saved"), "run").first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """The last leaderboard; an error when none was kept."""
    kept = _manifest(spark, path)
    if kept is None:
        raise FileNotFoundError(f"no leaderboard under {path}; train one first")
    return spark.read.parquet(f"{path}/runs/{kept['run']}/leaderboard")


@dataclass
class Loaded:
    """The best model of a kept run, ready for raw rows."""

    name: str
    task: str
    classes: list[str] | None
    key: list[str]
    prepare: Callable[[DataFrame], DataFrame]
    score: Callable[[DataFrame], DataFrame]

    def predict(self, raw: DataFrame) -> DataFrame:
        """``raw`` rows, prepared as for the training, with ``prediction`` and the class name ``predicted``."""
        scored = self.score(self.prepare(raw))
        if self.classes is None:
            return scored.select(*[col(k) for k in self.key], "prediction")
        names = small_frame(raw.sparkSession, [{"number": float(i), "predicted": n} for i, n in enumerate(self.classes)], "number double, predicted string")
        return scored.join(names, F.col("prediction") == F.col("number"), "left").select(*[col(k) for k in self.key], "prediction", "predicted")


def load_model(spark: SparkSession, path: str) -> Loaded:
    """The best model of the last run, with its preparation; an error when that run had none."""
    kept = _manifest(spark, path)
    if kept is None or kept["model"] is None:
        raise FileNotFoundError(f"no model under {path}; train one first")
    root, names, key = f"{path}/runs/{kept['run']}", list(kept["names"]), list(kept["key"])
    if kept["kind"] in ("trees", "trees and subtrees"):
        lower = spark.read.parquet(f"{root}/subtrees") if kept["kind"] != "trees" else None
        score = forests.TreeModel.read(spark.read.parquet(f"{root}/trees"), names, lower).predict
    elif kept["kind"] == "neighbours":
        train = spark.read.parquet(f"{root}/neighbours")
        score = lambda rows: knn_predict(train, rows.withColumn("label", F.lit(None).cast("double")), names, key, kept["task"], models.NEIGHBOURS)
    else:
        score = PipelineModel.load(f"{root}/model").transform
    prepare = lambda raw: raw
    if kept["text"] is not None:
        prepared = Preparation(names, list(kept["text"]), spark.read.parquet(f"{root}/fills"), spark.read.parquet(f"{root}/codes"))
        prepare = lambda raw: prepared.apply(raw, key)
    return Loaded(kept["model"], kept["task"], kept["classes"], key, prepare, score)
