"""Shapley values of any scored frame, and what is read off them."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import materialise, small_frame
from plumbline.functions.scalar import finite
from plumbline.operators.models import Fitted
from plumbline.operators.training import CLASSIFICATION

EXPLAINED_ROWS = 200
BACKGROUND_ROWS = 100
PERMUTATIONS = 24
TOP_FEATURES = 10
TOP_ROWS = 15
POINTS = 50


def coalition_weights(features: int, permutations: int = PERMUTATIONS, seed: int = 42) -> dict[frozenset[int], dict[int, float]]:
    """Coalition (set of features) -> feature -> weight of its value.

    Orders of the features are drawn without replacement; each adds one feature
    after the other, and what a feature changes is averaged over the orders. So
    the contributions of a row add up to its score minus the mean score, and
    they are exact once all orders are drawn. Coalitions that several orders
    pass through are scored once.
    """
    rng, orders = random.Random(seed), set()
    if math.factorial(min(features, 20)) <= permutations:
        orders = set(itertools.permutations(range(features)))
    while len(orders) < min(permutations, math.factorial(min(features, 20))):
        order = tuple(rng.sample(range(features), features))
        orders |= {order, order[::-1]}
    weights: dict[frozenset[int], dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for order in sorted(orders):
        for step, j in enumerate(order):
            weights[frozenset(order[:step])][j] -= 1 / len(orders)
            weights[frozenset(order[: step + 1])][j] += 1 / len(orders)
    return weights


def shapley_values(
    rows: DataFrame, background: DataFrame, names: list[str], key: list[str], score: Callable[[DataFrame], DataFrame],
    explained: int = EXPLAINED_ROWS, against: int = BACKGROUND_ROWS, permutations: int = PERMUTATIONS,
) -> DataFrame:
    """(key..., feature, value, contribution) of the first rows.

    ``score`` adds an array column ``outputs``, one entry per class (one entry
    for a regression). Each explained row meets each background row once per
    coalition; both are bounded, and the work is spread by rows.
    """
    order = [col(k) for k in key]
    first = rows.orderBy(*order).limit(explained).select(*order, *[col(n).cast("double").alias(n) for n in names])
    base = background.orderBy(*order).limit(against).select(*[col(n).cast("double").alias(n) for n in names]).collect()
    weights = list(coalition_weights(len(names), permutations).items())
    spark = rows.sparkSession
    backs = small_frame(
        spark, [{"back": k, **{f"b{i}": r[n] for i, n in enumerate(names)}} for k, r in enumerate(base)],
        ", ".join(["back int", *[f"b{i} double" for i in range(len(names))]]),
    )
    # at most one coalition per order and step, and 100 background rows, per explained row
    spread = first.repartition(spark.sparkContext.defaultParallelism, *order)
    held = small_frame(
        spark, [{"coalition": m, "holds": [i in members for i in range(len(names))]} for m, (members, _) in enumerate(weights)],
        "coalition int, holds array<boolean>",
    )
    combos = spread.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(len(weights) - 1)))).withColumn(
        "back", F.explode(F.sequence(F.lit(0), F.lit(len(base) - 1)))
    )
    mixed = combos.join(F.broadcast(held), "coalition").join(F.broadcast(backs), "back").select(
        *order, "coalition", *[F.when(F.get("holds", F.lit(i)), col(n)).otherwise(F.col(f"b{i}")).alias(n) for i, n in enumerate(names)]
    )
    values = score(mixed).select(*order, "coalition", F.posexplode("outputs").alias("output", "y")).groupBy(*order, "coalition", "output").agg(
        F.avg("y").alias("y")
    )
    parts = small_frame(
        spark,
        [{"coalition": m, "feature": names[j], "weight": w} for m, (_, fs) in enumerate(weights) for j, w in fs.items()],
        "coalition int, feature string, weight double",
    )
    split = values.join(F.broadcast(parts), "coalition").groupBy(*order, "output", "feature").agg(F.sum(F.col("weight") * F.col("y")).alias("phi"))
    outputs = F.count(F.lit(1))
    joined = split.groupBy(*order, "feature").agg(
        F.when(outputs == 1, F.max("phi")).otherwise(F.avg(F.abs("phi"))).alias("contribution")
    )
    long = first.select(*order, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), finite(col(n)).alias("value")) for n in names])))
    return long.join(joined, [*key, "feature"]).select(
        *order, "feature", F.round("value", 4).alias("value"), F.round("contribution", 6).alias("contribution")
    )


def linear_score(weights: dict[str, float], intercept: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """Scorer of a linear expression."""
    total = sum((col(n) * w for n, w in weights.items()), F.lit(intercept))
    return lambda df: df.withColumn("outputs", F.array(total))


def model_score(fitted: Fitted, task: str) -> Callable[[DataFrame], DataFrame]:
    """Scorer of a trained model: the prediction, the probability of the
    positive class, or one probability per class."""
    if fitted.pipeline is None and fitted.trees is None:
        raise ValueError(f"{fitted.name} has no pipeline to explain")

    def outputs(scored: DataFrame) -> Column:
        if task != CLASSIFICATION:
            return F.array("prediction")
        if "probability" not in scored.columns:
            return F.array("prediction")
        is_vector = isinstance(scored.schema["probability"].dataType, VectorUDT)
        p = vector_to_array("probability") if is_vector else F.col("probability")
        return F.when(F.size(p) == 2, F.slice(p, 2, 1)).otherwise(p)

    def score(df: DataFrame) -> DataFrame:
        scored = fitted.predict(df)
        return scored.withColumn("outputs", outputs(scored))

    return score


def shapley_global(values: DataFrame) -> DataFrame:
    """Mean absolute contribution of every feature, largest first."""
    return values.groupBy("feature").agg(F.round(F.avg(F.abs("contribution")), 6).alias("importance")).orderBy(F.desc("importance"), "feature")


def shapley_points(values: DataFrame, key: list[str], features: int = TOP_FEATURES, points: int = POINTS) -> DataFrame:
    """Value and contribution of the first rows, for the most important features."""
    values = materialise(values, "shapley")  # read twice; the model is called once
    top = shapley_global(values).limit(features)
    order = Window.partitionBy("feature").orderBy(*[col(k) for k in key])
    return values.join(F.broadcast(top), "feature").withColumn("point", F.row_number().over(order)).where(F.col("point") <= points).select(
        "feature", "point", "value", "contribution", "importance"
    )


def shapley_row(values: DataFrame, key: list[str], limit: int = TOP_ROWS) -> DataFrame:
    """Contributions to the first row, largest first, with their direction."""
    values = materialise(values, "shapley")
    first = values.select(*[col(k) for k in key]).orderBy(*[col(k) for k in key]).limit(1)
    return values.join(F.broadcast(first), key, "left_semi").orderBy(F.abs("contribution").desc(), "feature").limit(limit).select(
        "feature", "contribution", F.when(F.col("contribution") >= 0, "positive").otherwise("negative").alias("direction")
    )


def explain_or_importance(fitted: Fitted, task: str, rows: DataFrame, background: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """Global importance by Shapley values; when the model cannot be explained,
    its own feature importance with a warning."""
    try:
        # written here, so that an error while scoring is met here and not by whoever reads the result
        found = materialise(shapley_global(shapley_values(rows, background, names, key, model_score(fitted, task))), "importance")
        return found.withColumn("warning", F.lit(None).cast("string"))
    except Exception as failure:
        return shapley_fallback(fitted, rows.sparkSession, str(failure).split("\n")[0])


def shapley_fallback(fitted: Fitted, spark, reason: str, limit: int = TOP_ROWS) -> DataFrame:
    """Feature importance of the model, marked as a stand-in."""
    return fitted.importance_frame(spark).limit(limit).withColumn("warning", F.lit(f"no Shapley values: {reason}"))
