"""Lower parts of large forests: grown whole by tasks from the rows of a node, and kept as a table, a row a node.

The driver holds the upper part of the trees. A node that goes on in the table
has feature ``GOES_ON``; rows to predict meet the subtrees of their nodes in a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import materialise
from plumbline.operators import splits
from plumbline.operators.splits import between, dense, impurity, lists, matrix, means

GOES_ON = -2
#: Rows of nodes that a task grows at once, and numbers that it sends at once.
CHUNK_ROWS, SENT_NUMBERS = 50_000, 2_000_000
#: Points that meet a subtree at once.
MET_POINTS = 50_000

ROWS = "node bigint, tree int, x array<double>, stats array<double>"
SUBTREES = "node bigint, tree int, at bigint, feature int, threshold double, child bigint, gain double, value array<double>"


def grown(forest, x: np.ndarray, stats: np.ndarray, sizes: np.ndarray, depth: np.ndarray, classes: int, tries: int, max_depth: float, least: float, rng, drawn: bool) -> np.ndarray:
    """Grows a tree from each of consecutive groups of rows to its end, a level of all groups at a time; the group of every node.

    A node tries ``tries`` of the features that vary in it: a threshold ``drawn``
    evenly over its range, or every value.
    """
    pos = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(stats, np.r_[0, sizes.cumsum()[:-1]], axis=0)
    nodes, group = forest.add(means(total, classes)), np.arange(len(sizes))
    forest.roots = nodes.tolist()
    groups = [group]
    while True:
        starts = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        low, high = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        total = np.add.reduceat(stats, starts, axis=0)
        on = (impurity(total, classes) > least) & (high > low).any(axis=1) & (depth < max_depth)
        if not on.any():
            return np.concatenate(groups)
        inside = on[pos]
        x, stats, pos = x[inside], stats[inside], (on.cumsum() - 1)[pos[inside]]
        nodes, group, depth, low, high, total = (a[on] for a in (nodes, group, depth, low, high, total))
        varies, all_, n = high > low, impurity(total, classes), np.arange(len(nodes))
        order = np.argsort(np.where(varies, rng.random(varies.shape), 2.0), axis=1)[:, :tries]
        gain, feature, cut, side = np.full(len(nodes), -np.inf), np.zeros(len(nodes), dtype=int), np.zeros(len(nodes)), np.zeros_like(total)
        for j in range(order.shape[1]):
            f = order[:, j]
            v = x[np.arange(len(x)), f[pos]]
            if drawn:
                at, tried = n, low[n, f] + rng.random(len(n)) * (high[n, f] - low[n, f])
                tried = np.where(tried < high[n, f], tried, low[n, f])  # the largest value never goes left
                left = np.add.reduceat(stats * (v <= tried[pos])[:, None], np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]]), axis=0)
            else:
                by = np.lexsort((v, pos))
                here, vs, sums = pos[by], v[by], stats[by].cumsum(axis=0)
                first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                edge = np.flatnonzero((here[1:] == here[:-1]) & (vs[1:] > vs[:-1]))
                at, tried = here[edge], between(vs[edge], vs[edge + 1])
                left = sums[edge] - (sums - stats[by])[first][at]
            found = np.where(varies[at, f[at]], all_[at] - impurity(left, classes) - impurity(total[at] - left, classes), -np.inf)
            best = np.lexsort((np.arange(len(at)), -found, at))
            best = best[np.r_[True, np.diff(at[best]) != 0]] if len(best) else best
            best = best[found[best] > gain[at[best]]]
            m = at[best]
            gain[m], feature[m], cut[m], side[m] = found[best], f[m], tried[best], left[best]
        sides = np.stack([side, total - side], axis=1).reshape(-1, stats.shape[1])
        made = forest.split(nodes, feature, cut, np.maximum(gain, 0.0), means(sides, classes))
        pos = 2 * pos + (x[np.arange(len(x)), feature[pos]] > cut[pos])
        by = np.argsort(pos, kind="stable")
        x, stats, pos = x[by], stats[by], pos[by]
        nodes, group, depth = np.stack([made, made + 1], axis=1).ravel(), np.repeat(group, 2), np.repeat(depth + 1, 2)
        groups.append(group)


def _rows_of(forest, handed: np.ndarray, shares: Callable, width: int, parts: int):
    """Rows by the handed nodes that they fall into."""
    mine = np.zeros(len(forest.feature), dtype=bool)
    mine[handed] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SENT_NUMBERS // (len(forest.roots) * (width + parts + 2)))
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                x = matrix(part.column("x"), width)
                leaf = forest.leaves(x)
                drawn, of = shares(part)
                row, tree = np.nonzero(mine[leaf] & (drawn > 0))
                if len(row):
                    stats = dense(of(row, tree), len(row), parts)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[row, tree]), pa.array(tree.astype(np.int32)), lists(x[row]), lists(stats)], ["node", "tree", "x", "stats"])

    return run


def _grown_nodes(make: Callable, handed: np.ndarray, depth: np.ndarray, width: int, parts: int, classes: int, tries: int, max_depth: float, least: float, seed: int, drawn: bool):
    """Rows sorted by node: the subtrees of the nodes, of some nodes at a time."""

    def whole(table: pa.Table) -> pa.RecordBatch:
        node, tree = table.column("node").to_numpy(), table.column("tree").to_numpy()
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        numbers = lambda c, n: np.concatenate([matrix(part, n) for part in table.column(c).chunks])
        forest, rng = make(), np.random.default_rng([seed, int(node[0])])
        group = grown(
            forest, numbers("x", width), numbers("stats", parts), np.diff(np.r_[first, len(node)]), depth[np.searchsorted(handed, node[first])],
            classes, tries, max_depth, least, rng, drawn,
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(node[first][group]), pa.array(tree[first][group]), pa.array(np.arange(len(group))), pa.array(forest.feature.astype(np.int32)), pa.array(forest.threshold),
             pa.array(forest.left.astype(np.int64)), pa.array(forest.gain), lists(forest.value)],
            ["node", "tree", "at", "feature", "threshold", "child", "gain", "value"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(1, CHUNK_ROWS):
                table = pa.Table.from_batches(held)
                node = table.column("node").to_numpy()
                end = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
                if end:
                    yield whole(table.slice(0, end))
                held, size = table.slice(end).to_batches(), size - end
        if size:
            yield whole(pa.Table.from_batches(held))

    return run


def finish(forest, rows: DataFrame, size: int, shares: Callable, handed: tuple, make: Callable, width: int, parts: int, classes: int, tries: int, max_depth: float, least: float, seed: int, drawn: bool) -> DataFrame | None:
    """The subtrees of the ``handed`` nodes (node, depth, rows at most), written; the nodes are marked in the forest.

    Passes meet nodes of a bounded number of rows, so that what is shuffled at once is bounded.
    """
    nodes, depth, most = handed
    if not len(nodes):
        return None
    order = np.argsort(nodes)
    nodes, depth, most = nodes[order], depth[order], most[order]
    most = most * min(1.0, size * len(forest.roots) / most.sum())  # a tree has no more rows than the table
    turn = ((most.cumsum() - most) * (width + parts) // splits.DEALT_NUMBERS).astype(int)
    found = None
    for t in np.unique(turn):
        mine = turn == t
        parts_ = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(most[mine].sum() / (4 * CHUNK_ROWS)))
        met = rows.mapInArrow(_rows_of(forest, nodes[mine], shares, width, parts), ROWS)
        met = met.repartition(parts_, "node").sortWithinPartitions("node", "x", "stats")
        part = materialise(met.mapInArrow(_grown_nodes(make, nodes[mine], depth[mine], width, parts, classes, tries, max_depth, least, seed, drawn), SUBTREES), "subtrees")
        found = part if found is None else found.unionByName(part)
    forest.feature[nodes] = GOES_ON
    return found


def graft(forest, subtrees: DataFrame) -> None:
    """Takes the subtrees into the forest."""
    table = subtrees.toArrow().sort_by([("node", "ascending"), ("at", "ascending")])
    node, at, feature, child = (table.column(c).to_numpy() for c in ("node", "at", "feature", "child"))
    root = np.r_[True, node[1:] != node[:-1]]
    values = np.array(table.column("value").to_pylist(), dtype=float)
    place = np.zeros(len(node), dtype=np.int64)
    place[root] = node[root]
    place[~root] = forest.add(values[~root])  # children stay side by side, after their parent
    rank, most = root.cumsum() - 1, int(at.max()) + 1
    inner = feature >= 0
    forest.feature[place], forest.threshold[place], forest.gain[place] = feature, table.column("threshold").to_numpy(), table.column("gain").to_numpy()
    forest.left[place[inner]] = place[np.searchsorted(rank * most + at, rank[inner] * most + child[inner])]


def gains(subtrees: DataFrame, trees: int, features: int) -> np.ndarray:
    """The gain by tree and feature."""
    sums = np.zeros((trees, features))
    for r in subtrees.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
        sums[r["tree"], r["feature"]] = r["gain"]
    return sums


def _upper(forest, width: int):
    """Per point, a row of each tree that goes on, and one of the sum of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SENT_NUMBERS // (len(forest.roots) * (width + forest.outputs + 2)))
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                leaf = forest.leaves(matrix(part.column("x"), width))
                on = forest.feature[leaf] == GOES_ON
                near = np.zeros((len(leaf), forest.outputs))
                for t in range(leaf.shape[1]):
                    near += forest.value[leaf[:, t]] * ~on[:, t, None]
                row, tree = np.nonzero(on)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([part.column("x"), part.column("x").take(pa.array(row))]), pa.array(np.r_[np.full(len(leaf), -1), leaf[row, tree]]),
                     pa.array(np.r_[np.full(len(leaf), -1), tree].astype(np.int32)), pa.concat_arrays([lists(near), pa.nulls(len(row), pa.list_(pa.float64()))])],
                    ["x", "node", "tree", "value"],
                )

    return run


def _lower(make: Callable, width: int):
    """Rows sorted by node, its subtree before the points that meet it: the value of every point in the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ready, at = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, kind = batch.column("node").to_numpy(), batch.column("kind").to_numpy()
            starts = np.r_[0, np.flatnonzero((node[1:] != node[:-1]) | (kind[1:] != kind[:-1])) + 1, batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:]):
                part = batch.slice(s, e - s)
                if node[s] != now:
                    now, parts, ready = node[s], [], None
                if kind[s] == 0:
                    parts.append(part)
                    continue
                if ready is None:
                    table = pa.Table.from_batches(parts)
                    at = table.column("at").to_numpy()
                    ready = make()
                    ready.add(np.concatenate([matrix(c, ready.outputs) for c in table.column("value").chunks]))
                    ready.feature, ready.threshold = table.column("feature").to_numpy(), table.column("threshold").to_numpy()
                    ready.left = np.searchsorted(at, table.column("child").to_numpy())
                    ready.roots = [0]
                for o in range(0, part.num_rows, MET_POINTS):
                    few = part.slice(o, MET_POINTS)
                    leaf = ready.leaves(matrix(few.column("x"), width))[:, 0]
                    yield pa.RecordBatch.from_arrays([few.column("x"), few.column("tree"), lists(ready.value[leaf])], ["x", "tree", "value"])

    return run


def _plus(k: int) -> Callable:
    return lambda total, part: total + part["value"][k]


def totals(forest, subtrees: DataFrame, points: DataFrame, width: int, make: Callable) -> DataFrame:
    """``x, total``: the sum of the values that distinct ``points`` (x) have in all trees, added up in the order of the trees."""
    met = materialise(points.mapInArrow(_upper(forest, width), "x array<double>, node bigint, tree int, value array<double>"), "points")
    none = lambda kind: F.lit(None).cast(kind)
    trees = subtrees.select("node", F.lit(0).alias("kind"), "at", "feature", "threshold", "child", "value", "tree", none("array<double>").alias("x"))
    asked = met.where("node >= 0").select(
        "node", F.lit(1).alias("kind"), none("bigint").alias("at"), none("int").alias("feature"), none("double").alias("threshold"), none("bigint").alias("child"),
        none("array<double>").alias("value"), "tree", "x",
    )
    dealt = trees.unionByName(asked).repartition("node").sortWithinPartitions("node", "kind", "at")
    found = dealt.mapInArrow(_lower(make, width), "x array<double>, tree int, value array<double>")
    found = met.where("node < 0").select("x", "tree", "value").unionByName(found)
    parts = F.sort_array(F.collect_list(F.struct("tree", "value")))
    sums = [F.aggregate("parts", F.lit(0.0), _plus(k)) for k in range(forest.outputs)]
    return found.groupBy("x").agg(parts.alias("parts")).select("x", F.array(*sums).alias("total"))


def predicted(rows: DataFrame, names: list[str], totals_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the ``plumbline total`` of their point."""
    point = F.array(*[col(c).cast("double") for c in names])
    found = totals_of(rows.select(point.alias("x")).distinct()).select(F.col("x").alias("plumbline point"), F.col("total").alias("plumbline total"))
    return rows.withColumn("plumbline asked", point).join(found, F.col("plumbline asked") == F.col("plumbline point"), "left").drop("plumbline asked", "plumbline point")
