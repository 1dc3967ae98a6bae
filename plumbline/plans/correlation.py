"""Pairwise-complete Pearson correlation of all numeric column pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.functions.columns import col

Pair = tuple[str, str]
#: Cells of a block of rows that is multiplied at once.
BLOCK_CELLS = 2_000_000
#: A side whose spread on a pair's rows is below this share of its squares counts as constant.
CONSTANT = 1e-12


def correlations(df: DataFrame, moments: dict[str, dict], complete: set[str]) -> dict[Pair, float | None]:
    """r per pair of the columns in ``moments``; None when undefined.

    One scan for any number of columns and gaps: every task multiplies blocks
    of centred, zero-filled values X and their presence M, and the sums X'X,
    X'M, X²'M and M'M of all tasks are added up, one row per column.
    """
    result: dict[Pair, float | None] = {p: None for p in combinations(moments, 2)}
    names = [c for c, m in moments.items() if m["n"] > 1 and m["std"]]
    if len(names) < 2:
        return result
    gaps = not complete.issuperset(names)
    means = np.array([moments[c]["mean"] for c in names], dtype=float)
    parts = df.select(*[col(c).cast("double") for c in names]).mapInArrow(_block_sums(means, gaps), "i int, sums binary")
    rows = parts.groupBy("i").applyInPandas(_added, "i int, sums binary").collect()
    if not rows:
        return result
    sums = np.stack([np.frombuffer(r["sums"]).reshape(-1, len(names)) for r in sorted(rows, key=lambda r: r["i"])], axis=1)
    r = _pearson(sums, gaps)
    for i, j in combinations(range(len(names)), 2):
        value = float(r[i, j])
        result[names[i], names[j]] = None if math.isnan(value) else max(-1.0, min(1.0, value))
    return result


def _block_sums(means: np.ndarray, gaps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(means)
        total = np.zeros((4 if gaps else 1, p, p))
        step = max(1, BLOCK_CELLS // p)
        seen = False
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                seen = True
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(start, step).columns], axis=1) - means
                if gaps:
                    present = ~np.isnan(x)
                    x, m = np.where(present, x, 0.0), present.astype(float)
                    total[1] += x.T @ m
                    total[2] += (x * x).T @ m
                    total[3] += m.T @ m
                total[0] += x.T @ x
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array([total[:, i].tobytes() for i in range(p)], pa.binary())], ["i", "sums"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "sums": [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]})


def _pearson(sums: np.ndarray, gaps: bool) -> np.ndarray:
    """r from the sums; NaN where a side is constant on the rows of a pair."""
    with np.errstate(all="ignore"):
        if not gaps:
            spread = np.sqrt(np.diag(sums[0]))
            return sums[0] / np.outer(spread, spread)
        xy, x, xx, n = sums
        spread = xx - x * x / n
        spread = np.where((n > 1) & (spread > CONSTANT * xx), spread, np.nan)
        return (xy - x * x.T / n) / np.sqrt(spread * spread.T)
