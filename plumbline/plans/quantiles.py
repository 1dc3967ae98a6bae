"""Exact quantiles in bounded memory.

A column of up to ``EXACT_LIMIT`` values is sorted in one task: the counts prove
the bound first. Beyond that, a mergeable sketch, taken in the pass that also
takes the moments, gives two pivots around each wanted rank; one scan counts the
rows below, at and between them, and what lies between is sorted where that is
little. Where it is not, the pivots of the next round come from a random sample of
the bracket (Floyd and Rivest), which shrinks it over a hundredfold. Nothing is
shuffled but sketches, counters and bounded samples, and the counts make the
result exact whatever the pivots were.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

EXACT_LIMIT = 1_000_000
SAMPLE_SIZE = 200_000
DRAW = "plumbline random draw"
#: A sketch's ranks are right to this share of the rows.
ACCURACY = 10_000
#: Shares at which a sketch is read: close around the quartiles and the ends, evenly elsewhere.
GRID = sorted({i / 64 for i in range(1, 64)} | {q + d / ACCURACY for q in (0.25, 0.5, 0.75) for d in (-2, 2)} | {2 / ACCURACY, 1 - 2 / ACCURACY})


def quantiles(
    table,
    counts: dict[str, int],
    probs: list[float],
    exact_limit: int = EXACT_LIMIT,
    sample_size: int = SAMPLE_SIZE,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the columns in ``counts``
    (column -> number of non-null values) of a ``TableStats``."""
    spots = {}
    for c, n in counts.items():
        for p in probs:
            position = p * (n - 1)
            spots[(c, p)] = (math.floor(position), math.ceil(position), position)
    wanted = {c: sorted({k for p in probs for k in spots[(c, p)][:2]}) for c, n in counts.items() if n}
    values = _sorted_ranks(table, {c: ks for c, ks in wanted.items() if counts[c] <= exact_limit})
    large = {(c, k): counts[c] for c, ks in wanted.items() if counts[c] > exact_limit for k in ks}
    values.update(select_ranks(table.df, large, sample_size, table.sketches(sorted({c for c, _ in large}))))
    result: dict[str, list[float | None]] = {}
    for c, n in counts.items():
        result[c] = []
        for p in probs:
            lo, hi, position = spots[(c, p)]
            if not n:
                result[c].append(None)
                continue
            a, b = values[(c, lo)], values[(c, hi)]
            result[c].append(a if a == b else a + (b - a) * (position - lo))
    return result


def _sorted_ranks(table, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Ranks of small columns: each is sorted whole, in a task of its own."""
    names = list(wanted)
    if not names:
        return {}
    found = _picked(table.numeric_long(names), [[F.lit(k) for k in ks] for ks in wanted.values()])
    return {(c, k): found[p][j] for p, c in enumerate(names) for j, k in enumerate(wanted[c])}


def _picked(long: DataFrame, places: list[list[Column]]) -> dict[int, list[float | None]]:
    """From (p, x): per ``p`` the values at its ``places`` in sorted order, each
    an expression of ``m``, the number of values. Every ``p`` is sorted in a
    group of its own; only the picked values leave it."""
    slots = max(len(at) for at in places)
    spots = [F.get(F.array(*[at[min(j, len(at) - 1)].cast("bigint") for at in places]), F.col("p")).cast("int") for j in range(slots)]
    ordered = long.groupBy("p").agg(F.sort_array(F.collect_list("x")).alias("v")).withColumn("m", F.size("v"))
    rows = ordered.select("p", *[F.when(spot >= 0, F.get("v", spot)).alias(f"r{j}") for j, spot in enumerate(spots)]).collect()
    found = {row["p"]: [row[f"r{j}"] for j in range(slots)] for row in rows}
    return {p: found.get(p, [None] * slots) for p in range(len(places))}


def _inside(df: DataFrame, brackets: list[Bracket], draws: list[Column] | None = None) -> DataFrame:
    """(p, x): the values within each bracket, or those of them that are drawn."""
    tests = [b.holds() if draws is None else b.holds() & d for b, d in zip(brackets, draws or brackets)]
    cells = F.array(*[F.when(t, col(b.column).cast("double")) for b, t in zip(brackets, tests)])
    return df.select(F.posexplode(cells).alias("p", "x")).where("x IS NOT NULL")


@dataclass(frozen=True)
class Bracket:
    """Open value interval (low, high) of a column, holding ``inside`` values,
    with ``below`` values at or under ``low``."""

    column: str
    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self) -> Column:
        x = col(self.column).cast("double")
        test = x.isNotNull()
        if self.low is not None:
            test &= x > self.low
        if self.high is not None:
            test &= x < self.high
        return test


def select_ranks(
    df: DataFrame, wanted: dict[tuple[str, int], int], sample_size: int = SAMPLE_SIZE, sketches: dict[str, list[float]] | None = None
) -> dict[tuple[str, int], float]:
    """The value at each (column, 0-based rank), given column sizes and, for the first brackets, sketches."""
    found: dict[tuple[str, int], float] = {}
    open_at = {t: Bracket(t[0], None, None, 0, n) for t, n in wanted.items()}
    seed = 0
    while open_at:
        small = {t: b for t, b in open_at.items() if b.inside <= sample_size}
        if small:
            found.update(_finish(df, small))
            open_at = {t: b for t, b in open_at.items() if t not in small}
        if open_at:
            pivots = _read(open_at, sketches) if sketches else _pivots(df, open_at, sample_size, seed)
            sketches, seed = None, seed + 1
            open_at, done = _narrow(df, open_at, pivots)
            found.update(done)
    return found


def _grouped(targets: dict[tuple[str, int], Bracket]) -> dict[Bracket, list[tuple[str, int]]]:
    groups: dict[Bracket, list[tuple[str, int]]] = {}
    for t, b in targets.items():
        groups.setdefault(b, []).append(t)
    return groups


def _finish(df: DataFrame, targets: dict[tuple[str, int], Bracket]) -> dict[tuple[str, int], float]:
    """Sort the few values inside each bracket and read off the rank."""
    groups = _grouped(targets)
    found = _picked(_inside(df, list(groups)), [[F.lit(t[1] - b.below) for t in ts] for b, ts in groups.items()])
    return {t: found[p][j] for p, ts in enumerate(groups.values()) for j, t in enumerate(ts)}


def sketch(x: str = "x") -> Column:
    """The values at the shares of ``GRID``, nearly: an aggregate whose parts merge."""
    return F.percentile_approx(x, GRID, ACCURACY)


def _read(targets: dict[tuple[str, int], Bracket], sketches: dict[str, list[float]]):
    """Per target, the two read values that enclose its rank for sure, where there are any."""
    pivots = {}
    for t, b in targets.items():
        share, error = (t[1] + 0.5) / b.inside, 1.5 / ACCURACY
        low, high = bisect_right(GRID, share - error) - 1, bisect_left(GRID, share + error)
        values = sketches[t[0]]
        pivots[t] = (values[low] if low >= 0 else None, values[high] if high < len(GRID) else None)
    return pivots


def _pivots(df: DataFrame, targets: dict[tuple[str, int], Bracket], sample_size: int, seed: int):
    """Per target, two sampled values that very likely enclose its rank."""
    groups = _grouped(targets)
    names = sorted({b.column for b in groups})
    drawn = df.select(*[col(c) for c in names], F.rand(seed).alias(DRAW))
    places = []
    for b, ts in groups.items():
        at = []
        for t in ts:
            share = (t[1] - b.below + 0.5) / b.inside
            slack = 3 * math.sqrt(max(share * (1 - share), 1 / sample_size) / sample_size)
            at += [F.floor(F.col("m") * F.lit(share - slack)), F.ceil(F.col("m") * F.lit(share + slack))]
        places.append(at)
    long = _inside(drawn, list(groups), [col(DRAW) < sample_size / b.inside for b in groups])
    found = _picked(long, places)
    return {t: (found[p][2 * j], found[p][2 * j + 1]) for p, ts in enumerate(groups.values()) for j, t in enumerate(ts)}


def _narrow(df: DataFrame, open_at: dict, pivots: dict):
    """One scan that counts around every pivot, then moves each bracket."""
    aggs, index = [], {}
    for t, b in open_at.items():
        for p in pivots[t]:
            if p is None or (b, p) in index:
                continue
            index[(b, p)] = len(index)
            x, test = col(b.column).cast("double"), b.holds()
            aggs.append(F.count_if(test & (x < p)).alias(f"lt{index[(b, p)]}"))
            aggs.append(F.count_if(test & (x == p)).alias(f"eq{index[(b, p)]}"))
    row = df.agg(*aggs).first() if aggs else {}
    still, done = {}, {}
    for t, b in open_at.items():
        low, high, below, top = b.low, b.high, b.below, b.below + b.inside
        value = None
        for p in pivots[t]:
            if p is None:
                continue
            under = b.below + row[f"lt{index[(b, p)]}"]
            equal = row[f"eq{index[(b, p)]}"]
            if under <= t[1] < under + equal:
                value = p
            elif t[1] < under:
                if high is None or p < high:
                    high, top = p, under
            elif low is None or p > low:
                low, below = p, under + equal
        if value is not None:
            done[t] = value
        else:
            still[t] = Bracket(b.column, low, high, below, top - below)
    return still, done
