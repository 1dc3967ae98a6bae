"""Hard negatives by exact integer scores, computed as float32 products of residues.

Components become integers. Every matrix is reduced modulo several small primes,
to residues around zero that are small enough for float32 to add up their
products without rounding; the products of all primes together name one signed
integer, put together by mixed radix. Two passes of all anchors over all rows, in
tiles of a block of anchors and a lane of rows: the first keeps each anchor's best
rows of its own label, the second keeps, for each of these, the best rows of other
labels within a window below its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import written
from plumbline.llm.topk import weights

SCALE = 256
#: float32 holds every integer up to here.
EXACT = 2**24
#: Components that are multiplied before their sum is reduced again.
SPAN = 1024
#: Anchors of a tile, at the mean; lanes that the rows are dealt to; scores that are held at once.
TILE_ANCHORS, LANES, BLOCK_SCORES = 8192, 64, 1_000_000
LANE_ROWS = 4096

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "at bigint, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def moduli(dims: int, bound: int) -> list[int]:
    """The largest primes whose residues float32 multiplies exactly, as many as signed sums up to ``bound`` need."""
    half = math.isqrt(EXACT // max(1, min(dims, SPAN)))
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound + 1:
        while any(p % d == 0 for d in range(3, math.isqrt(p) + 1, 2)):
            p -= 2
        found.append(p)
        product *= p
        p -= 2
    return found


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """``rows`` modulo each prime, around zero, as float32."""
    out = []
    for p in primes:
        r = rows % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """``a @ b.T`` from the residues of both: 64-bit integers, held at the ends where they do not fit."""
    whole = math.prod(primes)
    kind = np.int64 if whole < 2**62 else object
    total, radix = None, 1
    for x, y, p in zip(a, b, primes):
        part = np.zeros((len(x), len(y)), dtype=np.int64)
        for s in range(0, x.shape[1], SPAN):
            part += (x[:, s : s + SPAN] @ y[:, s : s + SPAN].T).astype(np.int64)
        part %= p
        if total is None:
            total = part.astype(kind)
        else:
            digit = (part - total) % p * pow(radix, -1, p) % p
            total = total + digit * radix
        radix *= p
    total = np.where(total > whole // 2, total - whole, total)
    return total if kind is np.int64 else np.clip(total, LEAST, MOST).astype(np.int64)


def matrix(terms: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims`` columns, shorter ones filled with zeros."""
    ends = np.asarray(terms.offsets)
    lengths, flat = np.diff(ends), terms.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    rows = np.zeros((len(lengths), dims), dtype=np.int64)
    rows[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return rows


class Best:
    """The best ``k`` (score, id) of every slot so far; ties go to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.kth = k, np.full(slots, LEAST)
        self.slot = self.ids = self.score = np.zeros(0, dtype=np.int64)

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = (np.concatenate(x) for x in ((self.slot, slot), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score.astype(np.float64), slot)) if abs(score).max() < 2**53 else np.lexsort((ids, ~score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        kept = rank < self.k
        self.slot, self.ids, self.score = slot[kept], ids[kept], score[kept]
        last = rank == self.k - 1
        self.kth[slot[last]] = score[last]


class Tile:
    """A block of anchors that meets the rows of a lane, batch by batch."""

    def __init__(self, dims: int, primes: list[int], k: int, window: tuple[int, int] | None):
        self.dims, self.primes, self.k, self.window, self.parts, self.anchors = dims, primes, k, window, [], None

    def _ready(self) -> None:
        rows = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.at, self.own, self.label = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("at", "id", "label"))
        self.anchors = residues(matrix(rows.column("terms"), self.dims), self.primes)
        if self.window is None:
            self.best = Best(len(self.at), self.k)
            return
        positives = rows.column("positives").to_pylist()
        self.row = np.array([i for i, p in enumerate(positives) for _ in p], dtype=np.int64)
        self.rank = np.array([j for p in positives for j, _ in enumerate(p)], dtype=np.int64)
        self.positive = np.array([(x["id"], x["score"]) for p in positives for x in p], dtype=np.int64).reshape(-1, 2)
        low, high = self.window
        clip = lambda x: min(max(x, int(LEAST)), int(MOST))
        self.low = np.array([clip(-(-low * s // 100)) for s in self.positive[:, 1].tolist()], dtype=np.int64)
        self.high = np.array([clip(high * s // 100) for s in self.positive[:, 1].tolist()], dtype=np.int64)
        self.best = Best(len(self.row), self.k)

    def meet(self, rows: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.anchors is None:
            self._ready()
        step = max(1, BLOCK_SCORES // len(self.at))
        for s in range(0, rows.num_rows, step):
            part = rows.slice(s, step)
            ids, label = (part.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label"))
            score = products(self.anchors, residues(matrix(part.column("terms"), self.dims), self.primes), self.primes)
            same = self.label[:, None] == label[None, :]
            if self.window is None:
                q, d = np.nonzero(same & (self.own[:, None] != ids[None, :]) & (score >= self.best.kth[:, None]))
                self.best.add(q, ids[d], score[q, d])
                continue
            other = ~same & (self.own[:, None] != ids[None, :])
            floor = np.maximum(self.low, self.best.kth)
            for j in range(int(self.rank.max(initial=-1)) + 1):
                slots = np.flatnonzero(self.rank == j)
                mine = score[self.row[slots]]
                q, d = np.nonzero((mine <= self.high[slots, None]) & (mine >= floor[slots, None]) & other[self.row[slots]])
                self.best.add(slots[q], ids[d], mine[q, d])

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.anchors is None or not len(self.best.slot):
            return
        slot, none = self.best.slot, pa.nulls(len(self.best.slot), pa.int64())
        row = slot if self.window is None else self.row[slot]
        rank = np.zeros(len(slot)) if self.window is None else self.rank[slot]
        positive = [none, none] if self.window is None else [pa.array(self.positive[slot, 0]), pa.array(self.positive[slot, 1])]
        columns = [pa.array(self.at[row]), pa.array(rank.astype(np.int32)), pa.array(self.own[row]), *positive, pa.array(self.best.ids), pa.array(self.best.score)]
        yield pa.RecordBatch.from_arrays(columns, ["at", "slot", "anchor_id", "positive_id", "positive_score", "vec_id", "score"])


def _met(dims: int, primes: list[int], k: int, window: tuple[int, int] | None):
    """Rows sorted by tile, the anchors of a tile before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            key = batch.column("tile").to_numpy() * 2 + batch.column("kind").to_numpy()
            starts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else []
            for s, e in zip(starts[:-1], starts[1:]):
                if now != key[s] >> 1:
                    if tile:
                        yield from tile.found()
                    now, tile = key[s] >> 1, Tile(dims, primes, k, window)
                part = batch.slice(s, e - s)
                if key[s] & 1:
                    tile.meet(part)
                else:
                    tile.parts.append(part)
        if tile:
            yield from tile.found()

    return run


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For every row where ``anchor`` holds, its best ``positives`` other rows of the
    same ``label``, and for each of these the best ``negatives`` rows of another
    label whose score lies between ``window`` hundredths of the positive's; fewer
    where there are fewer. Scores are inner products of ``floor(scale * x)``, held
    at the ends of 64 bits; ties go to the smaller id. Rows with a null id, label
    or vector, or a null or non-finite component take no part; vectors of different
    length are multiplied over the components both have, an empty vector scores 0;
    rows that share the anchor's id are not its candidates; a repeated row counts
    each time, as an anchor too; a positive with no row in its window gives no
    rows, nor does an empty table; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), weights(F.col(vector_col), scale).alias("terms"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("terms").isNotNull())
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "terms")
    largest = F.coalesce(F.array_max(F.transform("terms", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"), F.max(F.size("terms")).alias("dims"), F.max(largest).alias("most")).first()
    dims = about["dims"] or 0
    primes = moduli(dims, dims * int((about["most"] or 0.0) * (1 + 1e-9) + 1) ** 2)
    groups, lanes = max(1, math.ceil(about["asked"] / TILE_ANCHORS)), max(1, min(LANES, math.ceil(about["n"] / LANE_ROWS)))

    def tiles(asks: DataFrame, k: int, within: tuple[int, int] | None) -> DataFrame:
        """Every block of anchors with every lane of rows; what a tile found is a few rows an anchor."""
        group = F.pmod(F.xxhash64("at"), F.lit(groups)) * lanes
        kept = ["at", "id", "label", "terms", "positives"]
        none = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
        left = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), group.alias("g"), *kept)
        left = left.select((F.col("g") + F.col("lane")).alias("tile"), F.lit(0).alias("kind"), *kept)
        right = rows.withColumn("positives", none).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.pmod(F.xxhash64("at"), F.lit(lanes)).alias("lane"), *kept)
        right = right.select((F.col("g") * lanes + F.col("lane")).alias("tile"), F.lit(1).alias("kind"), *kept)
        dealt = left.unionByName(right).repartitionById(groups * lanes, F.col("tile").cast("int")).sortWithinPartitions("tile", "kind")
        best = W.partitionBy("at", "slot").orderBy(F.desc("score"), "vec_id")
        found = dealt.mapInArrow(_met(dims, primes, k, within), FOUND)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asks = rows.where("asks").withColumn("positives", F.lit(None).cast("array<struct<id: bigint, score: bigint>>"))
    near = tiles(asks, positives, None).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("p"))
    near = near.select("at", F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    armed = written(asks.drop("positives").join(near, "at"), "positives")
    return tiles(armed, negatives, window).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
