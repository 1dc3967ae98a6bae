"""Best splits of the open nodes of trees, over all values of the features, a level of all trees at a time.

Features of few values have a bin a value. Of the others, tasks add up
coarse bins first. No split within a bin can leave less impurity than its two
outsides have, so most bins are ruled out by the best border; the values of the
rest are sorted, and each of them is tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PURE = 1e-12
#: Numbers of a pass's histograms, and the most open nodes of a pass.
PASS_CELLS, PASS_NODES = 4_000_000, 20_000
#: Nodes of so many rows at most are finished by tasks, where the driver would need many more passes or nodes: below this level, for one.
FINISHED_ROWS, DEEP_LEVELS = 100_000, 30
#: Numbers of the rows of nodes that are dealt to tasks at once; tables with fewer in all trees are dealt as soon as may be.
DEALT_NUMBERS = 200_000_000

LEVEL = "slot bigint, part int, total double, least double"


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Weight times Gini impurity of class weights, or the squared error of (weight, sum, sum of squares)."""
    if classes:
        w = stats.sum(axis=-1)
        return w - np.divide((stats**2).sum(axis=-1), w, out=np.zeros_like(w), where=w > 0)
    w = stats[..., 0]
    return stats[..., 2] - np.divide(stats[..., 1] ** 2, w, out=np.zeros_like(w), where=w > 0)


def weight(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def means(stats: np.ndarray, classes: int) -> np.ndarray:
    """Shares of the classes, or the mean."""
    if classes:
        return stats / stats.sum(axis=1, keepdims=True)
    return stats[:, 1:2] / stats[:, :1]


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A cut between neighbouring values, which leaves the larger on its right."""
    with np.errstate(all="ignore"):
        middle = low + (high - low) / 2
    return np.where((middle >= low) & (middle < high), middle, low)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def summed(frame: DataFrame) -> pa.Table:
    """Parts of the tasks added up by slot: a row a slot and part, as many as open nodes need."""
    return frame.groupBy("slot", "part").agg(F.sum("total").alias("total"), F.min("least").alias("least")).toArrow()


def dense(shares: list, rows: int, parts: int) -> np.ndarray:
    """What ``shares`` (part, values) says of every row, as a row of all parts."""
    stats = np.zeros((rows, parts))
    for part, v in shares:
        stats[np.arange(rows), part] += v
    return stats


@dataclass
class Growth:
    """What trees grow on.

    ``shares`` turns a batch of ``rows`` into the weight of every row in every
    tree, and a function from pairs of row and tree to their parts: the weight by
    class, or weight, sum and sum of squares, and what else adds up. ``cuts`` part
    the bins of every feature; they part all values of those that are ``whole``.
    """

    rows: DataFrame
    shares: Callable
    cuts: list[np.ndarray]
    whole: np.ndarray
    classes: int
    parts: int
    size: int = 0  # rows

    @property
    def bins(self) -> int:
        return max(1, *map(len, self.cuts)) + 1


def is_light(size: int, trees: int, numbers: int) -> bool:
    """Whether tasks grow whole trees of a table of ``size`` rows, each of so many ``numbers``: no passes are needed."""
    return size <= FINISHED_ROWS and size * trees * numbers <= DEALT_NUMBERS


def _met(forest, roots: list[int], growth: Growth, nodes: np.ndarray, chosen: np.ndarray) -> Callable:
    """From a batch, per tried feature: pairs of open node and row that try it, the feature's value and bin, and the row's parts."""
    place = np.full(len(forest.feature), -1)
    place[nodes] = np.arange(len(nodes))
    cuts, shares, starts = growth.cuts, growth.shares, np.array(roots)

    def met(batch: pa.RecordBatch) -> Iterator[tuple]:
        x = matrix(batch.column("x"), len(cuts))
        at = place[forest.leaves(x, starts)]
        drawn, of = shares(batch)
        row, tree = np.nonzero((at >= 0) & (drawn > 0))
        node = at[row, tree]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin b holds values up to cut b
        for j in range(chosen.shape[1]):
            f = chosen[node, j]
            tried = f >= 0
            r, n, f = row[tried], node[tried], f[tried]
            yield j, n, x[r, f], binned[r, f], of(r, tree[tried])

    return met


def _histograms(forest, roots: list[int], growth: Growth, nodes: np.ndarray, chosen: np.ndarray):
    """The parts by open node, tried feature and bin."""
    met = _met(forest, roots, growth, nodes, chosen)
    tries, bins, parts = chosen.shape[1], growth.bins, growth.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(nodes) * tries * bins * parts)
        for batch in batches:
            for j, n, _, b, shares in met(batch):
                slot = ((n * tries + j) * bins + b) * parts
                for part, v in shares:
                    np.add.at(total, slot + part, v)
        slot = np.flatnonzero(total)
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot // parts), pa.array((slot % parts).astype(np.int32)), pa.array(total[slot]), pa.nulls(len(slot), pa.float64())], ["slot", "part", "total", "least"])

    return run


def _values(forest, roots: list[int], growth: Growth, nodes: np.ndarray, chosen: np.ndarray, number: np.ndarray):
    """The parts by value, of the bins that have a ``number``."""
    met = _met(forest, roots, growth, nodes, chosen)
    tries, bins, parts = chosen.shape[1], growth.bins, growth.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, n, v, b, shares in met(batch):
                slot = number[(n * tries + j) * bins + b]
                inside = slot >= 0
                if inside.any():
                    stats = dense([(p[inside] if isinstance(p, np.ndarray) else p, s[inside]) for p, s in shares], int(inside.sum()), parts)
                    slot, v = slot[inside], v[inside]
                    order = np.lexsort((v, slot))
                    slot, v, stats = slot[order], v[order], stats[order]
                    first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (v[1:] != v[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(v[first]), lists(np.add.reduceat(stats, first, axis=0))], ["slot", "v", "stats"])

    return run


def _edges(before: np.ndarray, total: np.ndarray, classes: int):
    """Rows sorted by slot and value: the best cut between two values of every slot, once a batch that has one."""
    parts = total.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, parts)))  # the last value, which the next batch may go on with
        passed = np.zeros(parts)
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, v, stats = (np.concatenate(x) for x in zip(waits, (batch.column("slot").to_numpy(), batch.column("v").to_numpy(), matrix(batch.column("stats"), parts))))
            first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (v[1:] != v[:-1])])
            slot, v, stats = slot[first], v[first], np.add.reduceat(stats, first, axis=0)
            new = np.r_[True, slot[1:] != slot[:-1]]
            segment, sums = new.cumsum() - 1, stats.cumsum(axis=0)
            inside = sums - (sums - stats)[new][segment]
            inside[segment == 0] += passed
            at = np.flatnonzero(slot[1:] == slot[:-1])
            if len(at):
                left, whole = before[slot[at]] + inside[at], total[slot[at]]
                gain = impurity(whole, classes) - impurity(left, classes) - impurity(whole - left, classes)
                order = np.lexsort((np.arange(len(at)), -gain, slot[at]))
                best = order[np.r_[True, np.diff(slot[at][order]) != 0]]
                yield pa.RecordBatch.from_arrays([pa.array(slot[at[best]]), pa.array(gain[best]), pa.array(between(v[at[best]], v[at[best] + 1])), lists(left[best])], ["slot", "gain", "cut", "left"])
            waits, passed = (slot[-1:], v[-1:], stats[-1:]), inside[-1] - stats[-1]

    return run


def _best_splits(forest, roots: list[int], growth: Growth, nodes: np.ndarray, chosen: np.ndarray):
    """Per node: its parts, the gain of the best split over all values of the tried features, its feature, cut and left side; and per try, whether the feature is constant there."""
    classes, parts, bins, tries = growth.classes, growth.parts, growth.bins, chosen.shape[1]
    got = summed(growth.rows.mapInArrow(_histograms(forest, roots, growth, nodes, chosen), LEVEL))
    sums = np.zeros((len(nodes) * tries * bins, parts))
    sums[got.column("slot").to_numpy(), got.column("part").to_numpy()] = got.column("total").to_numpy()
    sums = sums.reshape(-1, tries, bins, parts)
    stats = sums[:, 0].sum(axis=1)  # every tried feature's bins add up to the node
    left = sums.cumsum(axis=2)
    right = stats[:, None, None] - left
    valid = (weight(left, classes) > 0.5) & (weight(right, classes) > 0.5)
    valid[:, :, -1] = False
    all_ = impurity(stats, classes)
    gains = np.where(valid, all_[:, None, None] - impurity(left, classes) - impurity(right, classes), -np.inf)
    best, node = gains.reshape(len(nodes), -1).argmax(axis=1), np.arange(len(nodes))
    j, b = np.divmod(best, bins)
    edges = np.full((len(growth.cuts), bins), np.inf)
    for f, c in enumerate(growth.cuts):
        edges[f, : len(c)] = c
    gain, feature, side = gains[node, j, b], chosen[node, j], left[node, j, b]
    cut = edges[feature, b]

    held = weight(sums, classes) > 0.5
    some, whole = chosen >= 0, growth.whole[chosen]
    constant = some & whole & (held.sum(axis=2) <= 1)
    hidden = held & (some & ~whole)[:, :, None]
    if hidden.any():
        before = left - sums
        bound = all_[:, None, None] - impurity(before, classes) - impurity(right, classes)
        hidden &= bound > gain[:, None, None]
    if hidden.any():
        slots = np.flatnonzero(hidden.ravel())
        number = np.full(hidden.size, -1)
        number[slots] = np.arange(len(slots))
        rows = growth.rows.mapInArrow(_values(forest, roots, growth, nodes, chosen, number), "slot bigint, v double, stats array<double>")
        rows = rows.repartition("slot").sortWithinPartitions("slot", "v")
        found = rows.mapInArrow(_edges(before.reshape(-1, parts)[slots], stats[slots // (tries * bins)], classes), "slot bigint, gain double, cut double, left array<double>").toArrow()
        at, inside = slots[found.column("slot").to_numpy()], found.column("gain").to_numpy()
        n, tried = at // (tries * bins), at // bins % tries
        flat = hidden.any(axis=2) & (held.sum(axis=2) == 1)
        flat[n, tried] = False
        constant |= flat
        order = np.lexsort((found.column("cut").to_numpy(), tried, -inside, n))
        order = order[np.r_[True, np.diff(n[order]) != 0]] if len(order) else order
        order = order[inside[order] > gain[n[order]]]
        n = n[order]
        gain[n], feature[n], cut[n] = inside[order], chosen[n, tried[order]], found.column("cut").to_numpy()[order]
        if len(order):
            side[n] = np.array(found.column("left").take(pa.array(order)).to_pylist(), dtype=float)
    return stats, gain, feature, cut, side, constant


def grow(forest, roots: list[int], growth: Growth, tries: int, max_depth: float, most: int | None, rng=None, idle: bool = False, values: Callable | None = None) -> tuple[list[tuple], float]:
    """Grows the trees from ``roots`` level by level, until nodes are pure, no feature varies, or they reach ``max_depth``.

    A node tries ``tries`` of the features that may vary in it, drawn by ``rng``,
    else the first; it draws again where all turn out constant. ``idle`` splits
    explain nothing by themselves. Small nodes, where the table is small, or a level
    needs several passes, is deep, or makes more than ``most`` nodes, are left and
    returned (node, depth, rows at most), with the impurity that counts as none.
    Without ``most`` none are left.
    """
    classes, width = growth.classes, len(growth.cuts)
    if values is None:
        values = lambda stats, tree: means(stats, classes)
    nodes, tree = np.array(roots), np.arange(len(roots))
    depth, fixed, stats, least, level, handed = np.zeros(len(roots), dtype=int), np.zeros((len(roots), width), dtype=bool), None, None, 0, []
    step = max(1, min(PASS_NODES, PASS_CELLS // (tries * growth.bins * growth.parts)))
    light = is_light(growth.size, len(roots), width + growth.parts)
    while len(nodes):
        if most is not None and level and (light or len(nodes) > step or level >= DEEP_LEVELS or len(forest.feature) + 2 * len(nodes) > most):
            rows = np.minimum(weight(stats, classes), growth.size)
            small = rows <= FINISHED_ROWS
            handed.append((nodes[small], depth[small], rows[small]))
            nodes, tree, depth, fixed, stats = (a[~small] for a in (nodes, tree, depth, fixed, stats))
            if not len(nodes):
                break
        draws = np.tile(np.arange(width) / width, (len(nodes), 1)) if rng is None else rng.random((len(nodes), width))
        order = np.argsort(np.where(fixed, 2.0, draws), axis=1, kind="stable")[:, :tries]
        chosen = np.where(np.take_along_axis(fixed, order, axis=1), -1, order)
        found = [_best_splits(forest, roots, growth, nodes[s : s + step], chosen[s : s + step]) for s in range(0, len(nodes), step)]
        stats, gain, feature, cut, side, constant = (np.concatenate(x) for x in zip(*found))
        if least is None:
            some = weight(stats, classes) > 0
            forest.value[nodes[some]] = values(stats[some], tree[some])
            least = PURE * max(float(impurity(stats, classes).max()), PURE)
        n, j = np.nonzero(constant)
        fixed[n, chosen[n, j]] = True
        open_ = (impurity(stats, classes) > least) & (depth < max_depth)
        again = np.flatnonzero(open_ & ~np.isfinite(gain) & ~fixed.all(axis=1))
        at = np.flatnonzero(open_ & np.isfinite(gain) & (idle | (gain > least)))
        sides = np.stack([side[at], stats[at] - side[at]], axis=1).reshape(-1, growth.parts)
        trees = np.repeat(tree[at], 2)
        made = forest.split(nodes[at], feature[at], cut[at], np.maximum(gain[at], 0.0), values(sides, trees))
        children, deeper, known = np.stack([made, made + 1], axis=1).ravel(), np.repeat(depth[at] + 1, 2), np.repeat(fixed[at], 2, axis=0)
        on = (impurity(sides, classes) > least) & (deeper < max_depth) & ~known.all(axis=1)
        nodes, tree, depth = np.r_[nodes[again], children[on]], np.r_[tree[again], trees[on]], np.r_[depth[again], deeper[on]]
        fixed, stats = np.concatenate([fixed[again], known[on]]), np.concatenate([stats[again], sides[on]])
        level += 1
    return handed, least
