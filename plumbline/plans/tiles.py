"""Nearest rows among those that share a cell with a query, met in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import materialise

#: Queries and rows of a tile, at the mean: a cell with more is dealt over several.
TILE_QUERIES, TILE_ROWS = 4096, 200_000
#: Distances that are held at once.
BLOCK_PAIRS = 1_000_000

FOUND = "x array<double>, label double, id string, dist double"


def cell_sizes(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``cell, queries, rows`` of the cells that hold both; the sum of their products is the number of compared pairs."""
    held = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    return asked.groupBy("cell").agg(F.count(F.lit(1)).alias("queries")).join(held, "cell")


def nearest_in_cells(asked: DataFrame, rows: DataFrame, dims: int, k: int) -> DataFrame:
    """(x, label, id, dist): candidates for the ``k`` nearest ``rows`` (cell, x, id,
    label) of every query ``asked`` (cell, x) over the cells they share.

    Holds every one of the nearest rows; a row that is met in several cells may
    come back several times. Ties go to the smaller id. A hot cell is split into
    tiles of some of its queries and some of its rows, so no cell is one task's work.
    """
    sizes = cell_sizes(asked, rows)
    split = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("bigint")
    sizes = materialise(sizes.select("cell", split("queries", TILE_QUERIES).alias("blocks"), split("rows", TILE_ROWS).alias("lanes")), "sizes")
    zero = F.lit(0).cast("bigint")
    left = asked.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("x"), F.col("blocks")).alias("block"), F.explode(F.sequence(zero, F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("kind"),
        "x", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("label"),
    )
    right = rows.join(sizes, "cell").select(
        "cell", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("lanes")).alias("lane"), F.lit(1).alias("kind"), "x", "id", "label",
    )
    tile = ["cell", "block", "lane"]
    dealt = left.unionByName(right).repartition(*tile).sortWithinPartitions(*tile, "kind")
    return dealt.mapInArrow(_met(dims, k), FOUND)


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("x").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def points(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class _Tile:
    """Some queries of a cell, and the nearest rows they have met so far."""

    def __init__(self, dims: int, k: int):
        self.dims, self.k, self.parts, self.queries = dims, k, [], None

    def _ready(self) -> None:
        self.queries = np.concatenate(self.parts)
        self.kth = np.full(len(self.queries), np.inf)
        self.slot, self.dist, self.label = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        self.ids = np.zeros(0, dtype="S1")

    def meet(self, rows: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.queries is None:
            self._ready()
        step = max(1, BLOCK_PAIRS // len(self.queries))
        for s in range(0, rows.num_rows, step):
            part = rows.slice(s, step)
            x = points(part.column("x"), self.dims)
            square = np.zeros((len(self.queries), len(x)))
            for i in range(self.dims):
                gap = self.queries[:, i, None] - x[None, :, i]
                square += gap * gap
            dist = np.sqrt(square)
            bound = self.kth
            if len(x) > self.k:
                bound = np.minimum(bound, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
            slot, row = np.nonzero(dist <= bound[:, None])
            if len(slot):
                ids = np.array(pc.cast(part.column("id"), pa.binary()).to_pylist(), dtype=np.bytes_)
                self._add(slot, dist[slot, row], ids[row], part.column("label").to_numpy(zero_copy_only=False)[row])

    def _add(self, slot: np.ndarray, dist: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        slot, dist, ids, label = (np.concatenate(x) for x in ((self.slot, slot), (self.dist, dist), (self.ids, ids), (self.label, label)))
        order = np.lexsort((ids, dist, slot))
        slot, dist, ids, label = slot[order], dist[order], ids[order], label[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = rank < self.k
        self.slot, self.dist, self.ids, self.label = slot[kept], dist[kept], ids[kept], label[kept]
        last = rank == self.k - 1
        self.kth[slot[last]] = dist[last]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.queries is None or not len(self.slot):
            return
        x = self.queries[self.slot]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * self.dims), pa.array(x.ravel()))
        ids = pa.array([i.decode() for i in self.ids.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([lists, pa.array(self.label), ids, pa.array(self.dist)], ["x", "label", "id", "dist"])


def _met(dims: int, k: int):
    """Rows sorted by tile, the queries of a tile before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "lane", "kind")])
            starts = np.r_[0, np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:]):
                here = tuple(key[:3, s])
                if here != now:
                    if tile:
                        yield from tile.found()
                    now, tile = here, _Tile(dims, k)
                part = batch.slice(s, e - s)
                if key[3, s]:
                    tile.meet(part)
                else:
                    tile.parts.append(points(part.column("x"), dims))
        if tile:
            yield from tile.found()

    return run
