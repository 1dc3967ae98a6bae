"""Tree models that grow level by level over a distributed table: extra trees, bagged trees, single trees and boosted ones.

Tasks send every row down the trees grown so far and add up, per open node, what
the node's possible splits need; the driver, which holds the upper part of the
trees, picks the splits. What it does not hold is grown by tasks. Equal rows are
counted once, as one row with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import materialise
from plumbline.operators import splits, subtrees
from plumbline.operators.splits import LEVEL, PURE, Growth, impurity, lists, matrix, means, summed
from plumbline.operators.training import CLASSIFICATION
from plumbline.plans import bins as bin_plan

#: Nodes that the driver and every task hold of a forest; what is below goes on in a table of subtrees.
MAX_NODES = 2_000_000
#: Features of up to so many values have a bin a value, others so many bins that are searched for their values where a split may lie.
FEW_VALUES, BINS = 256, 64
#: Rounds after which the running scores are written to the rows.
KEPT_ROUNDS = 10
#: Bagged cells that a task adds up before it sends them.
HELD_CELLS = 20_000
#: Rows a bagged cell from which on the cells of all tasks are added up.
JOINED_FROM = 2


@dataclass
class Forest:
    """Trees as arrays over all nodes. A leaf has feature -1, or -2 if it goes on in a table of subtrees; the right child follows the left."""

    outputs: int
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray | None = None

    def add(self, values: np.ndarray) -> np.ndarray:
        """New leaves with these values; their numbers."""
        n, size = len(values), len(self.feature)
        self.feature = np.r_[self.feature, np.full(n, -1, dtype=np.int32)]
        self.threshold = np.r_[self.threshold, np.zeros(n)]
        self.left = np.r_[self.left, np.zeros(n, dtype=np.int32)]
        self.gain = np.r_[self.gain, np.zeros(n)]
        self.value = values.astype(float) if self.value is None else np.concatenate([self.value, values])
        return np.arange(size, size + n)

    def split(self, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray, gain: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Nodes become inner ones with two new leaves each; the numbers of the left ones. ``values`` alternate left and right."""
        made = self.add(values)[::2]
        self.feature[nodes], self.threshold[nodes], self.gain[nodes], self.left[nodes] = feature, threshold, gain, made
        return made

    def leaves(self, x: np.ndarray, roots: list[int] | None = None) -> np.ndarray:
        """The leaf of every row in every tree."""
        at = np.tile(np.array(self.roots if roots is None else roots, dtype=np.int64), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if not (f >= 0).any():
                return at
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f >= 0, self.left[at] + right, at)

    def total(self, x: np.ndarray, roots: list[int] | None = None) -> np.ndarray:
        """The sum of the leaves' values of every row."""
        at = self.leaves(x, roots)
        out = np.zeros((len(x), self.outputs))
        for t in range(at.shape[1]):
            out += self.value[at[:, t]]
        return out

    def importances(self, features: int, more: np.ndarray | None = None) -> np.ndarray:
        """Share of the gain by feature, each tree weighing the same; ``more`` is gained further down."""
        inner = self.feature >= 0
        gains = np.zeros((len(self.roots), features)) if more is None else more.copy()
        np.add.at(gains, (self._trees()[inner], self.feature[inner]), self.gain[inner])
        sums = gains.sum(axis=1)
        shares = (gains[sums > 0] / sums[sums > 0, None]).sum(axis=0)
        return shares / shares.sum() if shares.sum() > 0 else shares

    def _trees(self) -> np.ndarray:
        """The tree of every node."""
        tree = np.full(len(self.feature), -1)
        tree[self.roots] = np.arange(len(self.roots))
        for node in range(len(self.feature)):  # children come after their parent
            if self.feature[node] >= 0:
                tree[self.left[node]] = tree[self.left[node] + 1] = tree[node]
        return tree


@dataclass
class TreeModel:
    """A forest with what turns the sum of its leaves into a prediction.

    Of a large forest, ``subtrees`` holds what is below the nodes that the driver has.
    """

    kind: str  # "mean" of the trees, "softmax" of their sum, their "sum", or "logistic": it is half the log odds of the second class
    forest: Forest
    start: np.ndarray
    names: list[str]
    classes: int  # 0: a number is predicted
    subtrees: DataFrame | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the classes, or one number; of a forest that the driver holds."""
        if self.subtrees is not None:
            raise ValueError("this forest is larger than the driver holds; use predict")
        return self._scores(self.forest.total(x))

    def _scores(self, total: np.ndarray) -> np.ndarray:
        if self.kind == "mean":
            return total / max(1, len(self.forest.roots)) + self.start
        if self.kind == "sum":
            return total + self.start
        if self.kind == "logistic":
            return softmax(np.concatenate([-total, total], axis=1) + np.concatenate([-self.start, self.start]))
        return softmax(total + self.start)

    def _found(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        if self.subtrees is None:
            return rows, F.pandas_udf(_scorer(self.scores), "array<double>")(_point(self.names))
        make, forest = partial(Forest, self.forest.outputs), self.forest
        rows = subtrees.predicted(rows, self.names, lambda points: subtrees.totals(forest, self.subtrees, points, len(self.names), make))
        upper = TreeModel(self.kind, Forest(forest.outputs, forest.roots), self.start, self.names, self.classes)
        return rows, F.pandas_udf(_scorer(upper._scores), "array<double>")("plumbline total")

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``, and the classes' ``probability``."""
        rows, found = self._found(rows)
        if not self.classes:
            return rows.withColumn("prediction", found[0]).drop("plumbline total")
        rows = rows.withColumn("probability", found).drop("plumbline total")
        best = F.array_position("probability", F.array_max("probability")) - 1  # the smallest class on ties
        return rows.withColumn("prediction", best.cast("double"))

    def importances(self) -> dict[str, float]:
        more = None if self.subtrees is None else subtrees.gains(self.subtrees, len(self.forest.roots), len(self.names))
        shares = zip(self.names, self.forest.importances(len(self.names), more).tolist())
        return dict(sorted(shares, key=lambda x: (-x[1], x[0])))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The model as a table of a row a node, and a row -1 with its kind and start."""
        f = self.forest
        tree = np.full(len(f.feature), -1)
        tree[f.roots] = np.arange(len(f.roots))
        cells = pa.table({
            "node": pa.array([-1, *range(len(f.feature))], pa.int64()), "root": pa.array([self.classes, *tree.tolist()], pa.int64()),
            "feature": pa.array([-1, *f.feature.tolist()], pa.int32()), "threshold": pa.array([0.0, *f.threshold.tolist()]),
            "child": pa.array([0, *f.left.tolist()], pa.int32()), "gain": pa.array([0.0, *f.gain.tolist()]),
            "value": pa.array([self.start.tolist(), *f.value.tolist()], pa.list_(pa.float64())), "kind": pa.array([self.kind, *[None] * len(f.feature)], pa.string()),
        })
        return spark.createDataFrame(cells)

    @staticmethod
    def read(frame: DataFrame, names: list[str], lower: DataFrame | None = None) -> TreeModel:
        rows = frame.toArrow().sort_by("node")
        head, rest = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        column = lambda c: rest.column(c).to_numpy()
        roots = column("root")
        forest = Forest(len(head["value"]), np.flatnonzero(roots >= 0)[np.argsort(roots[roots >= 0])].tolist(), column("feature"), column("threshold"), column("child"), column("gain"))
        forest.value = np.array(rest.column("value").to_pylist(), dtype=float)
        return TreeModel(head["kind"], forest, np.array(head["value"]), names, int(head["root"]), lower)


def _scorer(scores: Callable) -> Callable:
    import pandas as pd

    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        points, place = np.unique(np.stack(x.to_numpy()), axis=0, return_inverse=True)
        return pd.Series(list(scores(points)[place.ravel()]))

    score.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return score


def _point(names: list[str]) -> Column:
    return F.array(*[col(c).cast("double") for c in names])


def weighted(train: DataFrame, names: list[str]) -> DataFrame:
    """``x, y, w``: distinct rows of features and label with their number."""
    rows = train.select(_point(names).alias("x"), F.col("label").cast("double").alias("y"))
    return materialise(rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "weighted")


# -- extra trees ------------------------------------------------------------------------


def _row_stats(y: np.ndarray, w: np.ndarray, classes: int, centre: float) -> np.ndarray:
    if classes:
        stats = np.zeros((len(y), classes))
        stats[np.arange(len(y)), y.astype(int)] = w
        return stats
    y = y - centre
    return np.stack([w, w * y, w * y * y], axis=1)


def _row_shares(trees: int, classes: int, centre: float) -> Callable:
    """Every row counts for every tree."""

    def shares(batch: pa.RecordBatch):
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        if classes:
            of = lambda row, tree: [(y.astype(int)[row], w[row])]
        else:
            s = w * (y - centre)
            of = lambda row, tree: [(0, w[row]), (1, s[row]), (2, (s * (y - centre))[row])]
        return np.broadcast_to(w[:, None], (len(w), trees)), of

    return shares


def _centre(rows: DataFrame, classes: int) -> float:
    return 0.0 if classes else float(rows.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0])


def _finished(model: TreeModel, rows: DataFrame, size: int, shares: Callable, handed: list[tuple], parts: int, tries: int, max_depth: float, least: float, seed: int, drawn: bool) -> TreeModel:
    """The model with the subtrees of the nodes that its growth left: within the forest, if that stays within ``MAX_NODES``."""
    if not handed:
        return model
    left = tuple(np.concatenate(x) for x in zip(*handed))
    forest = model.forest
    lower = subtrees.finish(forest, rows, size, shares, left, partial(Forest, forest.outputs), len(model.names), parts, model.classes, tries, max_depth, least, seed, drawn)
    if lower is not None:
        if len(forest.feature) - len(left[0]) + lower.count() <= MAX_NODES:
            subtrees.graft(forest, lower)
        else:
            model.subtrees = lower
    return model


def _level(forest: Forest, open_nodes: np.ndarray, chosen: np.ndarray, cut: np.ndarray, classes: int, centre: float, width: int):
    """Per open node and drawn split: the statistics of the left side, and the least and largest value on both sides."""
    place = np.full(len(forest.feature), -1)
    place[open_nodes] = np.arange(len(open_nodes))
    roots = np.array(forest.roots)
    tries, parts = chosen.shape[1], classes or 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = len(open_nodes) * tries
        left, ends = np.zeros((slots, parts)), np.full((slots, 4), np.inf)
        for batch in batches:
            x = matrix(batch.column(0), width)
            stats = _row_stats(batch.column(1).to_numpy(), batch.column(2).to_numpy(), classes, centre)
            at = place[forest.leaves(x, roots)]
            row, tree = np.nonzero(at >= 0)
            node = at[row, tree]
            for j in range(tries):
                f = chosen[node, j]
                tried = f >= 0
                r, n, v = row[tried], node[tried], x[row[tried], f[tried]]
                slot, low = n * tries + j, v <= cut[n, j]
                for p in range(parts):
                    part = stats[r, p] * low
                    some = part != 0
                    np.add.at(left[:, p], slot[some], part[some])
                for side, is_low in ((0, low), (2, ~low)):
                    np.minimum.at(ends[:, side], slot[is_low], v[is_low])
                    np.minimum.at(ends[:, side + 1], slot[is_low], -v[is_low])
        slot, part = np.nonzero(left)
        slot2, part2 = np.nonzero(np.isfinite(ends))
        n, n2 = len(slot), len(slot2)
        if n + n2:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[slot, slot2]), pa.array(np.r_[part, part2 + parts].astype(np.int32)), pa.array(np.r_[left[slot, part], np.zeros(n2)]), pa.array(np.r_[np.full(n, np.inf), ends[slot2, part2]])],
                ["slot", "part", "total", "least"],
            )

    return run


def extra_trees(train: DataFrame, names: list[str], task: str, classes: int, trees: int = 100, max_depth: int | None = None, seed: int = 42) -> TreeModel:
    """Trees on all rows, without bagging, whose splits are the best of random ones.

    At every node each tried feature (the square root of their number for classes,
    all for numbers) gets one threshold, drawn evenly between the least and the
    largest value that the node is known to hold. A threshold with nothing on one
    side tells the true range, and the node draws again. Nodes grow until they are
    pure, no feature varies, or they reach a given ``max_depth``; of small tables,
    beyond ``MAX_NODES`` nodes, and many levels down, tasks grow them.
    """
    classes, deepest = classes if task == CLASSIFICATION else 0, math.inf if max_depth is None else max_depth
    rows, width = weighted(train, names), len(names)
    ranges = rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)], "y", "w")
    about = ranges.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(width) for n, f in (("low", F.min), ("high", F.max))], (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("mean")).first()
    centre = 0.0 if classes else float(about["mean"])
    if classes:
        root = np.zeros(classes)
        for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect():
            root[int(r["y"])] = r["w"]
    else:
        y = F.col("y") - centre
        root = np.array(list(rows.agg(F.sum("w"), F.sum(F.col("w") * y), F.sum(F.col("w") * y * y)).first()), dtype=float)

    rng = np.random.default_rng(seed)
    forest = Forest(classes or 1)
    nodes = forest.add(np.repeat(means(root[None], classes), trees, axis=0))
    forest.roots = nodes.tolist()
    stats, depth = np.repeat(root[None], trees, axis=0), np.zeros(trees, dtype=int)
    low = np.repeat(np.array([[about[f"low{i}"] for i in range(width)]]), trees, axis=0)
    high = np.repeat(np.array([[about[f"high{i}"] for i in range(width)]]), trees, axis=0)
    tries = max(1, int(np.sqrt(width))) if classes else width
    # sums of squares lose digits by the size of the whole; what is below that is no impurity
    least = PURE * max(float(impurity(root[None], classes)[0]), PURE)
    handed, passes, size = [], 0, rows.count()
    light = splits.is_light(size, trees, width + (classes or 3))

    while True:
        grows = (impurity(stats, classes) > least) & (high > low).any(axis=1) & (depth < deepest)
        if light or passes >= splits.DEEP_LEVELS or len(forest.feature) + 2 * grows.sum() > MAX_NODES:
            most = np.minimum(splits.weight(stats, classes), size)
            small = grows & (most <= splits.FINISHED_ROWS)
            handed.append((nodes[small], depth[small], most[small]))
            grows &= ~small
        nodes, stats, depth, low, high = nodes[grows], stats[grows], depth[grows], low[grows], high[grows]
        if not len(nodes):
            break
        passes += 1
        order = np.argsort(np.where(high > low, rng.random(low.shape), 2.0), axis=1)[:, :tries]
        pick = np.arange(len(nodes))[:, None]
        chosen = np.where((high > low)[pick, order], order, -1)
        a, b = low[pick, order], high[pick, order]
        cut = a + rng.random(a.shape) * (b - a)
        cut = np.where(cut < b, cut, a)  # the largest value never goes left
        found = summed(rows.mapInArrow(_level(forest, nodes, chosen, cut, classes, centre, width), LEVEL))
        slot, part = found.column("slot").to_numpy(), found.column("part").to_numpy()
        parts, slots = stats.shape[1], len(nodes) * tries
        left, ends = np.zeros((slots, parts)), np.full((slots, 4), np.inf)
        is_sum = part < parts
        left[slot[is_sum], part[is_sum]] = found.column("total").to_numpy()[is_sum]
        ends[slot[~is_sum], part[~is_sum] - parts] = found.column("least").to_numpy()[~is_sum]
        left, ends = left.reshape(len(nodes), tries, parts), ends.reshape(len(nodes), tries, 4)

        valid = np.isfinite(ends[..., 0]) & np.isfinite(ends[..., 2])
        right = stats[:, None] - left
        gain = np.where(valid, impurity(stats, classes)[:, None] - impurity(left, classes) - impurity(right, classes), -np.inf)
        for j in range(tries):  # the tried features' ranges are known now
            n = np.flatnonzero(chosen[:, j] >= 0)
            f = chosen[n, j]
            low[n, f], high[n, f] = np.minimum(ends[n, j, 0], ends[n, j, 2]), -np.minimum(ends[n, j, 1], ends[n, j, 3])
        best = gain.argmax(axis=1)
        done = np.isfinite(gain[np.arange(len(nodes)), best])
        at, j = np.flatnonzero(done), best[done]
        f = chosen[at, j]
        sides = np.stack([left[at, j], right[at, j]], axis=1).reshape(-1, parts)
        made = forest.split(nodes[at], f, cut[at, j], np.maximum(gain[at, j], 0.0), means(sides, classes))
        child_low, child_high = np.repeat(low[at], 2, axis=0), np.repeat(high[at], 2, axis=0)
        even = np.arange(0, 2 * len(at), 2)
        child_low[even, f], child_high[even, f] = ends[at, j, 0], -ends[at, j, 1]
        child_low[even + 1, f], child_high[even + 1, f] = ends[at, j, 2], -ends[at, j, 3]
        again = ~done
        nodes = np.r_[nodes[again], np.stack([made, made + 1], axis=1).ravel()]
        stats = np.concatenate([stats[again], sides])
        depth = np.r_[depth[again], np.repeat(depth[at] + 1, 2)]
        low, high = np.concatenate([low[again], child_low]), np.concatenate([high[again], child_high])
    model = TreeModel("mean", forest, np.full(classes or 1, centre), names, classes)
    return _finished(model, rows, size, _row_shares(trees, classes, centre), handed, classes or 3, tries, deepest, least, seed, True)


# -- bagged trees -----------------------------------------------------------------------


def _bagged(width: int, trees: int, classes: int, centre: float, seed: int):
    """Rows by cell, which is a point of the features: per tree, how often they were drawn (of classes: every class a row), and what the drawn numbers sum to.

    Every row is drawn a Poisson number of times for every tree; equal rows are
    drawn together, which is the same. A task sends its sums when it holds many
    cells, so that a cell may have several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column(0), width), batch.column(1).to_numpy()
            rows, n = np.unique(np.column_stack([x, y if classes else y - centre]), axis=0, return_counts=True)
            drawn = rng.poisson(np.broadcast_to(n[:, None], (len(rows), trees))).astype(float)
            held.append((rows if classes else rows[:, :width], drawn if classes else np.concatenate([drawn, drawn * rows[:, width:]], axis=1)))
            size += len(rows)
            if size >= HELD_CELLS:
                held = [_added_cells(held)]
                size = len(held[0][0])
                if size >= HELD_CELLS / 2:
                    yield _cell_batch(*held[0], width, trees, classes)
                    held, size = [], 0
        if held:
            yield _cell_batch(*_added_cells(held), width, trees, classes)

    return run


def _added_cells(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cells, sums = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort(cells.T[::-1])
    cells, sums = cells[order], sums[order]
    first = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
    return cells[first], np.add.reduceat(sums, first, axis=0)


def _joined_cells(width: int, trees: int, classes: int):
    """Rows sorted by cell, those of the same cell added up; a batch's last cell waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = []
        for batch in batches:
            if batch.num_rows:
                x, y, drawn = matrix(batch.column("x"), width), batch.column("y").to_numpy(), matrix(batch.column("drawn"), trees)
                sums = drawn if classes else np.concatenate([drawn, matrix(batch.column("sums"), trees)], axis=1)
                cells, sums = _added_cells([*waits, (np.column_stack([x, y]) if classes else x, sums)])
                waits = [(cells[-1:], sums[-1:])]
                if len(cells) > 1:
                    yield _cell_batch(cells[:-1], sums[:-1], width, trees, classes)
        for cells, sums in waits:
            yield _cell_batch(cells, sums, width, trees, classes)

    return run


def _bagged_cells(bagged: DataFrame, width: int, trees: int, classes: int) -> DataFrame:
    """Cells with their draws, written: a row a cell, where the tasks of the scan met the same cells.

    Every pass sends the histograms of each of its tasks, so that few cells must not
    be as many rows as there were tasks. Where most rows are cells of their own, they stay as they are.
    """
    rows = materialise(bagged, "bagged")
    met = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("x", "y")).alias("cells")).first()
    if met["rows"] < JOINED_FROM * met["cells"]:
        return rows
    parts = math.ceil(met["cells"] / HELD_CELLS)
    return materialise(rows.repartition(parts, "x", "y").sortWithinPartitions("x", "y").mapInArrow(_joined_cells(width, trees, classes), rows.schema), "joined")


def _cell_batch(cells: np.ndarray, sums: np.ndarray, width: int, trees: int, classes: int) -> pa.RecordBatch:
    y = cells[:, width] if classes else np.zeros(len(cells))
    return pa.RecordBatch.from_arrays([lists(cells[:, :width]), pa.array(y), lists(sums[:, :trees]), lists(sums[:, trees:])], ["x", "y", "drawn", "sums"])


def _bag_shares(trees: int, classes: int) -> Callable:
    """A cell counts for a tree as often as its rows were drawn."""

    def shares(batch: pa.RecordBatch):
        drawn = matrix(batch.column("drawn"), trees)
        if classes:
            y = batch.column("y").to_numpy().astype(int)
            return drawn, lambda row, tree: [(y[row], drawn[row, tree])]
        sums = matrix(batch.column("sums"), trees)

        def of(row, tree):
            w, s = drawn[row, tree], sums[row, tree]
            return [(0, w), (1, s), (2, s * s / w)]

        return drawn, of

    return shares


def random_forest(train: DataFrame, names: list[str], task: str, classes: int, trees: int = 100, max_depth: int | None = None, seed: int = 42) -> TreeModel:
    """Bagged trees, grown until nodes are pure, no feature varies, or they reach a given ``max_depth``.

    A node tries the square root of the features for classes, all for numbers, at
    every value that it holds. A scan of the rows draws the bags, and what is left
    are cells of equal features with their draws, the same cells of all tasks as
    one; passes over these serve a level of all trees, until tasks finish the nodes.
    """
    classes, width, deepest = classes if task == CLASSIFICATION else 0, len(names), math.inf if max_depth is None else max_depth
    cuts, whole = bin_plan.feature_bins(train, names, BINS, FEW_VALUES)
    label = F.col("label").cast("double")
    centre = 0.0 if classes else float(train.agg(F.avg(label)).first()[0])
    bagged = train.select(_point(names).alias("x"), label.alias("y")).mapInArrow(
        _bagged(width, trees, classes, centre, seed), "x array<double>, y double, drawn array<double>, sums array<double>"
    )
    rows = _bagged_cells(bagged, width, trees, classes)
    forest = Forest(classes or 1)
    forest.roots = forest.add(np.zeros((trees, classes or 1))).tolist()
    tries = math.ceil(math.sqrt(width)) if classes else width
    growth = Growth(rows, _bag_shares(trees, classes), cuts, whole, classes, classes or 3, rows.count())
    handed, least = splits.grow(forest, forest.roots, growth, tries, deepest, MAX_NODES, np.random.default_rng(seed), idle=True)
    model = TreeModel("mean", forest, np.full(classes or 1, centre), names, classes)
    return _finished(model, rows, growth.size, growth.shares, handed, growth.parts, tries, deepest, least, seed, False)


# -- a single tree ----------------------------------------------------------------------


def decision_tree(train: DataFrame, names: list[str], task: str, classes: int, max_depth: int = 10) -> TreeModel:
    """One tree on all rows whose nodes take the best split over all values of all features."""
    classes, rows = classes if task == CLASSIFICATION else 0, weighted(train, names)
    cuts, whole = bin_plan.feature_bins(train, names, BINS, FEW_VALUES)
    centre = _centre(rows, classes)
    forest = Forest(classes or 1)
    forest.roots = forest.add(np.zeros((1, classes or 1))).tolist()
    splits.grow(forest, forest.roots, Growth(rows, _row_shares(1, classes, centre), cuts, whole, classes, classes or 3), len(names), max_depth, None)
    return TreeModel("mean", forest, np.full(classes or 1, centre), names, classes)


# -- boosting ---------------------------------------------------------------------------


def _kept(model: TreeModel, since: int, width: int):
    """Rows with what the trees from ``since`` on add to their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = matrix(batch.column("scores"), len(model.start)) + model.forest.total(matrix(batch.column("x"), width), model.forest.roots[since:])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "w")), lists(scores)], ["x", "y", "w", "scores"])

    return run


def _residual_shares(model: TreeModel, since: int, width: int, residuals: Callable) -> Callable:
    """Weight, residual, its square and curvature, of a tree an output; scores are those written and what the trees from ``since`` on add."""
    forest, old, outputs = model.forest, model.forest.roots[since:], len(model.start)

    def shares(batch: pa.RecordBatch):
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        scores = matrix(batch.column("scores"), outputs)
        if old:
            scores = scores + forest.total(matrix(batch.column("x"), width), old)
        r, h = residuals(scores, y)

        def of(row, tree):
            v, n = r[row, tree], w[row]
            return [(0, n), (1, n * v), (2, n * v * v), (3, n * h[row, tree])]

        return np.broadcast_to(w[:, None], r.shape), of

    return shares


def _boosted(model: TreeModel, rows: DataFrame, bins: tuple, rounds: int, depth: int, residuals: Callable, leaf: Callable) -> TreeModel:
    """``rounds`` of a tree an output, fitted to the ``residuals`` of scores and labels; ``leaf`` turns a node's parts and the round into what it adds."""
    width, outputs, written = len(model.names), len(model.start), 0
    rows = materialise(rows.withColumn("scores", F.array(*[F.lit(float(s)) for s in model.start])), "scores")
    for turn in range(rounds):
        roots = model.forest.add(np.zeros((outputs, outputs))).tolist()

        def values(stats: np.ndarray, tree: np.ndarray) -> np.ndarray:
            out = np.zeros((len(stats), outputs))
            out[np.arange(len(stats)), tree] = leaf(stats, turn)
            return out

        growth = Growth(rows, _residual_shares(model, written, width, partial(residuals, turn)), *bins, 0, 4)
        splits.grow(model.forest, roots, growth, width, depth, None, values=values)
        model.forest.roots += roots
        if len(model.forest.roots) - written >= KEPT_ROUNDS * outputs:
            rows = materialise(rows.mapInArrow(_kept(model, written, width), "x array<double>, y double, w double, scores array<double>"), "scores")
            written = len(model.forest.roots)
    return model


def _class_residuals(turn: int, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = -softmax(scores)
    r[np.arange(len(y)), y.astype(int)] += 1
    return r, np.abs(r) * (1 - np.abs(r))


def boosted_classes(train: DataFrame, names: list[str], classes: int, rounds: int = 100, step: float = 0.1, depth: int = 3) -> TreeModel:
    """Gradient boosting of softmax deviance: a tree per class every round, all from the same passes.

    Scores start at the logs of the class shares. A round fits one regression tree
    of ``depth`` levels per class to the residuals, over all values of the features,
    its leaves taking one Newton step; passes over the rows serve one level of all
    classes' trees.
    """
    rows, bins = weighted(train, names), bin_plan.feature_bins(train, names, BINS, FEW_VALUES)
    prior = np.zeros(classes)
    for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect():
        prior[int(r["y"])] = r["w"]
    start = np.log(np.maximum(prior, 1e-9) / prior.sum())
    model = TreeModel("softmax", Forest(classes), start, names, classes)
    leaf = lambda s, turn: step * (classes - 1) / classes * np.divide(s[:, 1], s[:, 3], out=np.zeros(len(s)), where=s[:, 3] > 1e-150)
    return _boosted(model, rows, bins, rounds, depth, _class_residuals, leaf)


def _log_residuals(turn: int, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sign = 2 * y[:, None] - 1
    r = sign if turn == 0 else 4 * sign / (1 + np.exp(np.minimum(2 * sign * scores, 700)))
    return r, np.zeros_like(r)


def _square_residuals(turn: int, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = (y[:, None] - scores) * (1 if turn == 0 else 2)
    return r, np.zeros_like(r)


def boosted(train: DataFrame, names: list[str], task: str, rounds: int = 100, step: float = 0.1, depth: int = 3) -> TreeModel:
    """Gradient boosting of two classes (labels 0 and 1) or a number as MLlib does it, but over all values of the features.

    The first tree is fitted to the labels and counts in full, the others to the
    negative gradient of log loss or squared error and count by ``step``.
    """
    rows, bins, classes = weighted(train, names), bin_plan.feature_bins(train, names, BINS, FEW_VALUES), 2 if task == CLASSIFICATION else 0
    model = TreeModel("logistic" if classes else "sum", Forest(1), np.array([_centre(rows, classes)]), names, classes)
    leaf = lambda s, turn: (step if turn else 1.0) * s[:, 1] / s[:, 0]
    return _boosted(model, rows, bins, rounds, depth, _log_residuals if classes else _square_residuals, leaf)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
