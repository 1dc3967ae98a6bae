"""Moments of all numeric columns from one scan, a batch of rows at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.functions.columns import col

#: What is known of a part of a column: its rows, their sum, mean and central sums of powers, range and signs.
FIELDS = ("n", "total", "mean", "m2", "m3", "m4", "low", "high", "zeros", "negatives")
#: Parts that a task holds before it adds them up.
HELD_PARTS = 256


def moments(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Per column with values: ``n, mean, variance, g1, g2, min, max, zeros, negatives``; g1 and g2 are the population's
    skewness and excess kurtosis, None of a constant. A task sends a row a column."""
    schema = "p int, " + ", ".join(f"{f} double" for f in FIELDS)
    parts = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).mapInArrow(_task_parts(len(names)), schema)
    rows = parts.groupBy("p").applyInPandas(_joined, schema).collect()
    return {names[r["p"]]: _facts(r) for r in rows if r["n"]}


def _part(x: np.ndarray) -> list[float]:
    x = x[~np.isnan(x)]
    if not len(x):
        return [0.0] * 6 + [np.inf, -np.inf, 0.0, 0.0]
    mean = x[0] + (x - x[0]).mean()  # exact for a constant
    away = x - mean
    square = away * away
    return [len(x), x.sum(), mean, square.sum(), (square * away).sum(), (square * square).sum(), x.min(), x.max(), (x == 0).sum(), (x < 0).sum()]


def _merged(parts: np.ndarray) -> np.ndarray:
    """One part a column out of many (part, column, field)."""
    n, total, mean, m2, m3, m4, low, high, zeros, negatives = np.moveaxis(parts, 2, 0)
    with np.errstate(all="ignore"):
        some = n > 0
        first = np.take_along_axis(mean, some.argmax(axis=0)[None], axis=0)
        rows = n.sum(axis=0)
        centre = first[0] + np.where(some, n * (mean - first), 0.0).sum(axis=0) / np.maximum(rows, 1)
        d = np.where(some, mean - centre, 0.0)
        return np.stack([
            rows, total.sum(axis=0), centre, (m2 + n * d**2).sum(axis=0), (m3 + 3 * m2 * d + n * d**3).sum(axis=0),
            (m4 + 4 * m3 * d + 6 * m2 * d**2 + n * d**4).sum(axis=0), low.min(axis=0), high.max(axis=0), zeros.sum(axis=0), negatives.sum(axis=0),
        ], axis=1)


def _task_parts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            with np.errstate(all="ignore"):
                held.append(np.array([_part(c.to_numpy(zero_copy_only=False)) for c in batch.columns], dtype=float))
            if len(held) >= HELD_PARTS:
                held = [_merged(np.stack(held))]
        if held:
            sums = _merged(np.stack(held))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *(pa.array(np.ascontiguousarray(f)) for f in sums.T)], ["p", *FIELDS])

    return run


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    sums = _merged(pdf[list(FIELDS)].to_numpy(dtype=float)[:, None, :])
    return pd.DataFrame(sums, columns=list(FIELDS)).assign(p=pdf["p"].iloc[0])[["p", *FIELDS]]


def _facts(row) -> dict:
    r = {k: math.nan if v is None else v for k, v in row.asDict().items()}  # pandas takes NaN for a gap
    n, m2 = int(r["n"]), r["m2"]
    mean = r["mean"] if math.isfinite(r["mean"]) else r["total"] / n
    with np.errstate(all="ignore"):
        g1 = None if m2 == 0 else float(np.sqrt(n) * r["m3"] / np.sqrt(np.float64(m2) ** 3))
        g2 = None if m2 == 0 else float(n * r["m4"] / np.float64(m2) ** 2 - 3)
    return {
        "n": n, "mean": mean, "variance": m2 / (n - 1) if n > 1 else None, "g1": g1, "g2": g2, "min": r["low"], "max": r["high"],
        "zeros": int(r["zeros"]), "negatives": int(r["negatives"]),
    }
