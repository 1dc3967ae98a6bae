"""Candidate models. Each trains on the whole training share: with MLlib, bar
the nearest neighbours, the forests, and boosting of several classes. MLlib's
trees learn from cells of binned features that weigh as much as their rows; where
bins would hide values, they can be had over all values (``fit_whole``)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import small_frame
from plumbline.operators import forests
from plumbline.operators.neighbours import knn_predict
from plumbline.operators.training import CLASSIFICATION, Features
from plumbline.plans import bins

SEED = 42
TREES = 100
# forests grow to their end unless a depth is asked for
FOREST_DEPTH = None
TREE_DEPTH = 10
BOOST_ROUNDS = 100
NEIGHBOURS = 5


@dataclass
class Fitted:
    """A trained candidate: predicts a frame of feature columns."""

    name: str
    predict: Callable[[DataFrame], DataFrame]
    importances: dict[str, float]
    pipeline: PipelineModel | None = None
    trees: forests.TreeModel | None = None

    def importance_frame(self, spark) -> DataFrame:
        rows = [{"feature": f, "importance": round(v, 6)} for f, v in self.importances.items()]
        return small_frame(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def random_forest(features: Features, train: DataFrame, max_depth: int | None = FOREST_DEPTH):
    """100 bagged trees; a regressor sees every feature at every split."""
    return forests.random_forest(train, features.names, features.task, len(features.classes or []), TREES, max_depth, SEED)


def extra_trees(features: Features, train: DataFrame, max_depth: int | None = FOREST_DEPTH):
    """100 trees without bagging that split at random thresholds."""
    return forests.extra_trees(train, features.names, features.task, len(features.classes or []), TREES, max_depth, SEED)


def gradient_boosting(features: Features, train: DataFrame):
    """100 rounds of depth-3 trees, step 0.1; several classes are boosted together."""
    common = dict(maxIter=BOOST_ROUNDS, stepSize=0.1, maxDepth=3, seed=SEED)
    if features.task != CLASSIFICATION:
        return GBTRegressor(**common)
    if len(features.classes) <= 2:
        return GBTClassifier(**common)
    return forests.boosted_classes(train, features.names, len(features.classes), BOOST_ROUNDS)


def decision_tree(features: Features, train: DataFrame):
    """One tree of depth 10."""
    kind = DecisionTreeClassifier if features.task == CLASSIFICATION else DecisionTreeRegressor
    return kind(maxDepth=TREE_DEPTH, seed=SEED)


def logistic(features: Features, train: DataFrame):
    """Logistic loss plus half the squared weights, at C = 1."""
    return LogisticRegression(maxIter=500, regParam=1.0 / train.count(), elasticNetParam=0.0, standardization=False)


def ridge(features: Features, train: DataFrame):
    """Squared loss plus the squared weights at alpha = 1. MLlib scales the
    penalty by the label, so the deviation of the label undoes that."""
    row = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    return LinearRegression(regParam=row[1] / row[0], elasticNetParam=0.0, standardization=False, solver="normal")


def lasso(features: Features, train: DataFrame):
    """Half mean squared loss plus the absolute weights at alpha = 1."""
    return LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False, maxIter=2000)


CLASSIFIERS = {
    "Random Forest": random_forest, "Extra Trees": extra_trees, "Gradient Boosting": gradient_boosting,
    "Decision Tree": decision_tree, "KNN": None, "Logistic Regression": logistic,
}
REGRESSORS = {
    "Random Forest": random_forest, "Extra Trees": extra_trees, "Gradient Boosting": gradient_boosting,
    "Decision Tree": decision_tree, "KNN": None, "Ridge": ridge, "Lasso": lasso,
}


def candidates(task: str) -> dict:
    return CLASSIFIERS if task == CLASSIFICATION else REGRESSORS


def fit(name: str, features: Features, train: DataFrame, max_depth: int | None = FOREST_DEPTH, whole: bool = False) -> Fitted:
    """Train one candidate by name; ``max_depth`` bounds the trees of the forests. A decision tree and boosting see
    features of more than ``bins.COUNTED`` values in 32 bins, or, if ``whole``, at all their values."""
    names = features.names
    if name == "KNN":
        return Fitted(name, lambda rows: knn_predict(train, rows, names, features.key, features.task, NEIGHBOURS), {})
    make = candidates(features.task)[name]
    options = {"max_depth": max_depth} if make in (random_forest, extra_trees) else {}
    made = make(features, train, **options)
    if isinstance(made, forests.TreeModel):
        return _grown(name, made)
    if make in (gradient_boosting, decision_tree):
        return fit_tree(name, made, features, train, whole)
    return fit_estimator(name, made, features, train)


def fit_whole(name: str, features: Features, train: DataFrame) -> Fitted:
    """Train one candidate by name, which looks at every value of every feature."""
    return fit(name, features, train, whole=True)


def _grown(name: str, made: forests.TreeModel) -> Fitted:
    return Fitted(name, made.predict, made.importances(), trees=made)


def fit_tree(name: str, estimator, features: Features, train: DataFrame, whole: bool = False) -> Fitted:
    """A tree model of MLlib on the weighted cells of the features' bins: its many passes are over cells.

    A feature of up to ``bins.COUNTED`` values has a bin a value. If one has more, and
    none of its values is to be hidden (``whole``), the same model is grown over all values.
    """
    names = features.names
    cuts, parted = bins.feature_bins(train, names, few=bins.COUNTED)
    if whole and not parted.all():
        if isinstance(estimator, (GBTClassifier, GBTRegressor)):
            return _grown(name, forests.boosted(train, names, features.task, BOOST_ROUNDS))
        return _grown(name, forests.decision_tree(train, names, features.task, len(features.classes or []), TREE_DEPTH))
    binner = bins.bucketizer(names, cuts)
    cells = bins.cells(train, binner, "label", features.task == CLASSIFICATION)
    # room for every bin, and so much that MLlib looks for bins in all cells instead of a sample
    estimator = estimator.setMaxBins(max(bins.BINS, 1 + max(map(len, cuts)), 1 + math.isqrt(cells.count())))
    assembler = VectorAssembler(inputCols=binner.getOutputCols(), outputCol="features_vec")
    estimator = estimator.setFeaturesCol("features_vec").setLabelCol("label").setWeightCol("weight")
    model = estimator.fit(assembler.transform(_declared(features, cells)))
    pipeline = PipelineModel([binner, assembler, model])
    return Fitted(name, pipeline.transform, _importances(model, names), pipeline)


def fit_estimator(name: str, estimator, features: Features, train: DataFrame) -> Fitted:
    assembler = VectorAssembler(inputCols=features.names, outputCol="features_vec")
    estimator = estimator.setFeaturesCol("features_vec").setLabelCol("label")
    model = estimator.fit(assembler.transform(_declared(features, train)))
    pipeline = PipelineModel([assembler, model])
    return Fitted(name, pipeline.transform, _importances(model, features.names), pipeline)


def _declared(features: Features, rows: DataFrame) -> DataFrame:
    """``rows`` with the number of classes on the label; a written table may have lost it."""
    if features.task != CLASSIFICATION or not features.classes:
        return rows
    return rows.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": max(2, len(features.classes))}})


def _importances(model, names: list[str]) -> dict[str, float]:
    """Feature importance of tree models, largest first."""
    if not hasattr(model, "featureImportances"):
        return {}
    values = model.featureImportances.toArray()
    return dict(sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda x: (-x[1], x[0])))


def coefficients(fitted: Fitted, spark) -> DataFrame:
    """Weights of a linear model, with its intercept."""
    model = fitted.pipeline.stages[-1]
    names = fitted.pipeline.stages[0].getInputCols()
    rows = [{"term": n, "weight": float(w)} for n, w in zip(names, model.coefficients.toArray())]
    rows.append({"term": "(intercept)", "weight": float(model.intercept)})
    return small_frame(spark, rows, "term string, weight double").select("term", F.round("weight", 6).alias("weight"))
