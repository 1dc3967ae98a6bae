"""Cuts of features, and the rows between them: tree models look at no more of a row than the bins that it falls into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import materialise

#: Bins of a feature; MLlib's trees take as many.
BINS = 32
#: Features of up to so many values are cut by the exact counts of these, others at approximate quantiles.
COUNTED, ACCURACY = 1000, 10_000


def _counted(width: int, limit: int):
    """``p, x, n``: the values of every feature of a task with their numbers; of a feature with more than ``limit``, just more than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = [np.zeros(0)] * width, [np.zeros(0)] * width
        for batch in batches:
            for p in range(width):
                if len(seen[p]) <= limit:
                    values, n = np.unique(batch.column(p).to_numpy(zero_copy_only=False), return_counts=True)
                    seen[p], place = np.unique(np.r_[seen[p], values], return_inverse=True)
                    counts[p] = np.bincount(place, weights=np.r_[counts[p], n])
        for p, values in enumerate(seen):
            if len(values):
                at = slice(limit + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values[at]), p, dtype=np.int32)), pa.array(values[at]), pa.array(counts[p][at])], ["p", "x", "n"])

    return run


def feature_bins(rows: DataFrame, names: list[str], bins: int = BINS, few: int = BINS) -> tuple[list[np.ndarray], np.ndarray]:
    """The cuts of every feature: between all its values where these are ``few`` (``COUNTED`` at most), else under ``bins``, so that as many rows lie between them; and whether all values are parted.

    A value is left of a cut that it does not exceed. Features have no missing values.
    """
    points = rows.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    found = points.mapInArrow(_counted(len(names), COUNTED), "p int, x double, n double").groupBy("p", "x").agg(F.sum("n").alias("n"))
    found = found.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("values")).where(F.size("values") <= COUNTED)
    counted = {r["p"]: np.array(r["values"], dtype=float).T for r in found.collect()}
    cuts = {p: _between(values, bins, few) for p, values in counted.items()}
    whole = np.array([i in counted and len(cuts[i]) == counted[i].shape[1] - 1 for i in range(len(names))], dtype=bool)
    many = [i for i in range(len(names)) if i not in cuts]
    if many:
        at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        row = points.agg(*[F.percentile_approx(f"x{i}", at, ACCURACY).alias(f"q{i}") for i in many]).first()
        cuts |= {i: np.unique(np.array(row[f"q{i}"] or [], dtype=float)) for i in many}
    return [cuts[i] for i in range(len(names))], whole


def feature_cuts(rows: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The cuts of every feature, under ``bins`` of them."""
    return feature_bins(rows, names, bins, bins)[0]


def _between(counted: np.ndarray, bins: int, few: int) -> np.ndarray:
    """Cuts between neighbouring values: all of ``few``, or those nearest to even shares of the rows."""
    values, n = counted
    with np.errstate(all="ignore"):
        middle = values[:-1] + (values[1:] - values[:-1]) / 2
    middle = np.where((middle >= values[:-1]) & (middle < values[1:]), middle, values[:-1])
    if len(values) <= max(bins, few):
        return middle
    below = n.cumsum()[:-1]
    shares = n.sum() * np.arange(1, bins) / bins
    return middle[np.unique(np.abs(below[None, :] - shares[:, None]).argmin(axis=1))]


def bucketizer(names: list[str], cuts: list[np.ndarray]) -> Bucketizer:
    """Numbers of bins in place of values, as a stage of a pipeline."""
    above = [np.nextafter(c if len(c) else np.zeros(1), np.inf) for c in cuts]  # a bucket leaves its upper end out
    splits = [[-np.inf, *a[np.isfinite(a)].tolist(), np.inf] for a in above]
    return Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"plumbline bin {i}" for i in range(len(names))])


def cells(rows: DataFrame, binner: Bucketizer, label: str, classes: bool) -> DataFrame:
    """One row a cell of bins, and a class, with its ``weight``, the number of rows; of numbers, with their mean.

    No split divides a cell, so a split's gain is the same over cells as over their rows.
    """
    binned, names = binner.transform(rows), binner.getOutputCols()
    numbers = [F.col(c).alias(c, metadata={}) for c in names]  # bins have an order; the stage marks them as categories
    y = col(label).cast("double")
    weight = F.count(F.lit(1)).cast("double").alias("weight")
    if classes:
        found = binned.groupBy(*numbers, y.alias(label)).agg(weight)
    else:
        found = binned.groupBy(*numbers).agg(F.avg(y).alias(label), weight)
    return materialise(found, "cells")
