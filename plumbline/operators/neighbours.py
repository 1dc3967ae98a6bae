"""k nearest neighbours: exact, by cells around pivots, or nearly so, by hashed buckets of random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.functions.frames import materialise
from plumbline.operators.training import CLASSIFICATION
from plumbline.plans.tiles import first_k, nearest_in_cells, points

#: Pivots travel with the tasks. They are as many as the square root of the rows, which this holds up to 1e12 rows of 30 features.
PIVOT_BYTES = 256_000_000
#: Distances to pivots are computed for so many pairs at once.
BLOCK_PAIRS = 4_000_000
SLACK = 1e-9

#: Hashed form: tables, rows of a bucket at the mean, cut bits that a query also tries flipped, rows that the cuts are learned from.
TABLES, BUCKET_ROWS, PROBES, SAMPLE_ROWS = 8, 256, 3, 10_000


def _base(train: DataFrame, names: list[str], key: list[str], k: int) -> DataFrame:
    """``x, id, label``: of equal vectors only the first ``k`` rows can be among the nearest."""
    if k < 1:
        raise ValueError("k must be positive")
    point = F.array(*[col(c).cast("double") for c in names]).alias("x")
    identity = F.concat_ws("|", *[col(c).cast("string") for c in key]).alias("id")
    copies = Window.partitionBy("x").orderBy("id")
    base = train.select(point, identity, F.col("label").cast("double").alias("label")).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k)
    return materialise(base.drop("copy"), "neighbours")


def _asked(queries: DataFrame, names: list[str]) -> DataFrame:
    return queries.select(F.array(*[col(c).cast("double") for c in names]).alias("x")).distinct()


def nearest(train: DataFrame, queries: DataFrame, names: list[str], key: list[str], k: int) -> DataFrame:
    """(x, label, dist, rank): the ``k`` nearest training rows of each distinct
    query vector ``x``, ties broken by the row key.

    Training vectors belong to the cell of their nearest pivot, of which there
    are as many as the square root of the rows, drawn by hash. A query first
    meets the cells nearest to it, until they hold ``k`` rows; its k-th distance
    there bounds the answer. Then it meets every other cell that can hold a
    nearer row, in all dimensions at once: a row is at least as far from the
    query as their distances to the pivot differ, and a cell no nearer than its
    border with the query's own cell. Equal vectors are reduced to their first k
    rows at the start, so no vector, however frequent, pairs off with itself.
    """
    base = _base(train, names, key, k)
    size = base.count()
    if not size:
        raise ValueError("no training rows")
    wanted = max(1, min(PIVOT_BYTES // (8 * len(names)), math.isqrt(size)))
    drawn = base.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(wanted).collect()
    pivots = np.array([r["x"] for r in drawn], dtype=float).reshape(len(drawn), len(names))

    rows = base.select("x", "id", "label").mapInArrow(_assigned(pivots), "x array<double>, id string, label double, cell bigint, r double")
    rows = materialise(rows, "cells")
    cells = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    counts = np.array([cells[c]["n"] if c in cells else 0 for c in range(len(pivots))])
    reach = np.array([[cells[c]["low"], cells[c]["high"]] if c in cells else [np.inf, -np.inf] for c in range(len(pivots))])
    asked = _asked(queries, names)
    near = "x array<double>, cell bigint"
    first = materialise(asked.withColumn("tau", F.lit(float("inf"))).mapInArrow(_cells(pivots, counts, reach, k, False), near), "queries")
    found = materialise(first_k(nearest_in_cells(first, rows, len(names), k), k).drop("rank"), "found")
    bound = found.groupBy("x").agg(F.max("dist").alias("tau"), F.count(F.lit(1)).alias("n"))
    bound = bound.select("x", F.when(F.col("n") >= k, F.col("tau")).otherwise(F.lit(float("inf"))).alias("tau"))
    more = materialise(bound.mapInArrow(_cells(pivots, counts, reach, k, True), near), "more")
    return first_k(found.unionByName(nearest_in_cells(more, rows, len(names), k)), k).select("x", "label", "dist", "rank")


def nearest_hashed(
    train: DataFrame, queries: DataFrame, names: list[str], key: list[str], k: int,
    tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, probes: int = PROBES, seed: int = 42,
) -> DataFrame:
    """(x, label, dist, rank) as ``nearest``, of the rows that share a bucket with the query: work that grows with the rows, not with their square.

    Every table hashes a vector to bits, each the side of a random projection's
    median; there are as many bits as leave ``bucket_rows`` rows in a bucket at the
    mean. A query tries its own bucket and those across the ``probes`` cuts that it
    is nearest to. Distances are exact, hot buckets are split into tiles, and a
    query whose buckets hold fewer than ``k`` rows is answered by ``nearest``.
    Medians are learned from a sample of at most ``SAMPLE_ROWS`` rows.
    """
    base = _base(train, names, key, k)
    size = base.count()
    if not size:
        raise ValueError("no training rows")
    bits = max(0, math.ceil(math.log2(max(1.0, size / bucket_rows))))
    sample = np.array([r["x"] for r in base.select("x").orderBy(F.xxhash64("x"), "id").limit(SAMPLE_ROWS).collect()], dtype=float)
    spread = sample.std(axis=0)
    lines = np.random.default_rng(seed).normal(size=(tables, bits, len(names))) * (spread > 0)
    cuts = np.median(np.einsum("nd,tbd->tbn", sample, lines), axis=2) if bits else np.zeros((tables, 0))
    rows = base.mapInArrow(_hashed(lines, cuts, 0), "x array<double>, id string, label double, cell bigint")
    asked = materialise(_asked(queries, names), "queries")
    met = asked.mapInArrow(_hashed(lines, cuts, probes), "x array<double>, cell bigint")
    rows, met = materialise(rows, "buckets"), materialise(met, "probes")
    found = nearest_in_cells(met, rows, len(names), k).dropDuplicates(["x", "id"])  # a row may be met in several tables
    found = materialise(first_k(found, k).select("x", "label", "dist", "rank"), "found")
    full = found.where(F.col("rank") == k).select("x")
    rest = asked.join(full, "x", "left_anti")
    if not rest.head(1):
        return found
    rest = rest.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return found.join(full, "x", "left_semi").unionByName(nearest(train, rest, names, key, k))


def _hashed(lines: np.ndarray, cuts: np.ndarray, probes: int):
    """Rows with the number of their bucket in every table; queries also with those across the nearest cuts."""
    tables, bits, dims = lines.shape
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = points(batch.column(0), dims)
            for t in range(tables):
                away = x @ lines[t].T - cuts[t]
                own = (away > 0) @ weights + (t << 48)
                yield _with_cell(batch, own)
                for b in np.argsort(np.abs(away), axis=1, kind="stable")[:, :probes].T:
                    yield _with_cell(batch, own ^ weights[b])

    return run


def _with_cell(batch: pa.RecordBatch, cell: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def _assigned(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_PAIRS // pivots.size)
        for batch in batches:
            x = points(batch.column(0), pivots.shape[1])
            cell, r = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
            for s in range(0, len(x), step):
                d = _distances(x[s : s + step], pivots)
                cell[s : s + step] = d.argmin(axis=1)
                r[s : s + step] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], [*batch.schema.names, "cell", "r"])

    return run


def _cells(pivots: np.ndarray, counts: np.ndarray, reach: np.ndarray, k: int, others: bool):
    """Cells that a query meets: the nearest that hold ``k`` rows, or the others that can hold one within ``tau``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_PAIRS // pivots.size)
        for batch in batches:
            x, tau = points(batch.column(0), pivots.shape[1]), batch.column(1).to_numpy(zero_copy_only=False)
            query, cell = [], []
            for s in range(0, len(x), step):
                d = _distances(x[s : s + step], pivots)
                order = np.argsort(d, axis=1, kind="stable")
                held = np.cumsum(counts[order], axis=1)
                taken = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(taken, order, held - counts[order] < k, axis=1)
                if others:
                    t = tau[s : s + step, None] * (1 + SLACK) + SLACK
                    own = order[:, 0]
                    between = _distances(pivots[own], pivots)
                    with np.errstate(all="ignore"):
                        border = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * between)
                    border = np.where(np.isfinite(border), border, 0.0)
                    taken = ~taken & (counts > 0) & (d - reach[:, 1] <= t) & (reach[:, 0] - d <= t) & (border * (1 - SLACK) <= t)
                q, c = np.nonzero(taken & (counts > 0))
                query.append(q + s)
                cell.append(c)
            chosen = np.concatenate(query) if query else np.zeros(0, dtype=np.int64)
            if len(chosen):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chosen)), pa.array(np.concatenate(cell).astype(np.int64))], ["x", "cell"])

    return run


def knn_predict(train: DataFrame, test: DataFrame, names: list[str], key: list[str], task: str, k: int = 5, search=nearest) -> DataFrame:
    """Test rows with ``prediction``: the majority class (smallest on ties) or
    the mean label of the nearest training rows, as ``search`` (``nearest`` or
    ``nearest_hashed``) finds them."""
    near = search(train, test, names, key, k)
    if task == CLASSIFICATION:
        votes = near.groupBy("x", "label").agg(F.count("*").alias("votes"))
        answer = votes.groupBy("x").agg(F.min(F.struct((-F.col("votes")).alias("neg"), "label")).alias("top"))
        answer = answer.select("x", F.col("top.label").alias("prediction"))
    else:
        answer = near.groupBy("x").agg(F.avg("label").alias("prediction"))
    rows = test.withColumn("x", F.array(*[col(c).cast("double") for c in names]))
    return rows.join(answer, "x", "left").drop("x")
