"""Exact top-k by inner product, pruned a block of documents at a time.

Vector components become integer term weights. Documents are ordered by their
strongest terms and cut into blocks; a block keeps the largest and smallest
weight of every term and a forward index (its rows). For a query the block's
bound is the sum of the best each term can give. Queries take their first k-th
score from the block of highest bound, then meet all blocks in descending
bounds, and score only those whose bound reaches the k-th score so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import written

SCALE = 64
BLOCK_ROWS = 512
#: Blocks that travel together, and queries that are scored together.
SLICE_BLOCKS, QUERY_ROWS = 8, 512

SLICES = "dim int, ids binary, rows binary, high binary, low binary"


def weights(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, or null where a component is null or not finite."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale)))))


def _packed(rows_each: int, blocked: bool):
    """Rows ``id, terms`` as matrices of up to ``rows_each`` rows, shorter vectors filled with zeros."""

    def pack(ids: list[int], terms: list[list[int]]) -> pa.RecordBatch:
        dim = max(map(len, terms))
        rows = np.zeros((len(ids), dim), dtype=np.int64)
        for i, t in enumerate(terms):
            rows[i, : len(t)] = t
        columns = [pa.array([dim], pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())]
        names = ["dim", "ids", "rows"]
        if blocked:
            starts = range(0, len(ids), BLOCK_ROWS)
            high = np.stack([rows[s : s + BLOCK_ROWS].max(axis=0) for s in starts])
            low = np.stack([rows[s : s + BLOCK_ROWS].min(axis=0) for s in starts])
            columns += [pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())]
            names += ["high", "low"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            terms += batch.column(1).to_pylist()
            while len(ids) >= rows_each:
                yield pack(ids[:rows_each], terms[:rows_each])
                ids, terms = ids[rows_each:], terms[rows_each:]
        if ids:
            yield pack(ids, terms)

    return run


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=np.int64)
    return flat.reshape(-1, dim) if dim else np.zeros((1, 0), dtype=np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers over the components both have, exactly."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * dim
    if most < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The summed term maxima of every block for every query, never below what a row of it can score."""
    best, least = _product(np.maximum(queries, 0), high), _product(np.minimum(queries, 0), low)
    total = best.astype(np.float64) + least.astype(np.float64)
    return total + np.abs(total) * 1e-9


def _best_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for r in batch.to_pylist():
            reach = bounds(_matrix(r["rows"], r["dim"]), _matrix(r["high"], r["d_dim"]), _matrix(r["low"], r["d_dim"]))
            best = reach.argmax(axis=1)
            out[0] += [r["part"]] * len(best)
            out[1] += range(len(best))
            out[2] += reach.max(axis=1).tolist()
            out[3] += [r["slice"]] * len(best)
            out[4] += best.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["part", "at", "bound", "slice", "block"])


def _first_kth(k: int):
    """The k-th score of chosen queries within their chosen block, and its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                at = np.array(r["at"])
                docs, ids = _matrix(r["d_rows"], r["d_dim"]), np.frombuffer(r["d_ids"], dtype=np.int64)
                scores = _product(_matrix(r["rows"], r["dim"])[at], docs)
                own = np.frombuffer(r["ids"], dtype=np.int64)[at][:, None] == ids[None, :]
                for i, mine, row in zip(r["at"], own, scores):
                    left, names = row[~mine], ids[~mine]
                    if len(left) >= k:
                        last = np.lexsort((names, -left))[k - 1]
                        for column, value in zip(out, (r["part"], i, int(left[last]), int(names[last]))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["part", "at", "kth", "last"])

    return run


def top_in_blocks(queries: np.ndarray, own: np.ndarray, kth: np.ndarray, last: np.ndarray, docs: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int):
    """Per query the best k of these blocks that are no worse than score ``kth`` of id ``last``: arrays (query, id, score), and the number of scored rows."""
    kth, last = kth.copy(), last.copy()
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(queries)
    reach, scored = bounds(queries, high, low), 0
    for block in np.argsort(-reach.sum(axis=0), kind="stable"):
        live = np.flatnonzero(reach[:, block] >= kth)  # a score that equals the k-th may win by its id
        if not len(live):
            continue
        rows = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
        scores = _product(queries[live], docs[rows])
        scored += scores.size
        for q, row in zip(live, scores):
            hit = np.flatnonzero(((row > kth[q]) | (row == kth[q]) & (ids[rows] <= last[q])) & (ids[rows] != own[q]))
            if not len(hit):
                continue
            s, i = np.concatenate([best[q][0], row[hit]]), np.concatenate([best[q][1], ids[rows][hit]])
            order = np.lexsort((i, -s))[:k]
            best[q] = (s[order], i[order])
            if len(order) == k:
                kth[q], last[q] = s[order[-1]], i[order[-1]]
    n = [len(s) for s, _ in best]
    return np.repeat(np.arange(len(queries)), n), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best]), scored


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                own, dim = np.frombuffer(r["ids"], dtype=np.int64), r["d_dim"]
                kth, last = np.full(len(own), np.iinfo(np.int64).min), np.full(len(own), np.iinfo(np.int64).max)
                for first in r["kths"] or []:
                    kth[first["at"]], last[first["at"]] = first["kth"], first["last"]
                docs, ids = _matrix(r["d_rows"], dim), np.frombuffer(r["d_ids"], dtype=np.int64)
                q, found, scores, _ = top_in_blocks(_matrix(r["rows"], r["dim"]), own, kth, last, docs, ids, _matrix(r["high"], dim), _matrix(r["low"], dim), k)
                if len(q):
                    columns = [pa.array(np.full(len(q), r["part"])), pa.array(q.astype(np.int32)), pa.array(own[q]), pa.array(found), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "at", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``query`` holds, its k best other rows.

    Scores are inner products of ``floor(64 * x)``, held at the ends of 64 bits; ties go to the smaller id; a
    query with fewer candidates gets all. Rows with a null id, a null vector, or
    a null or non-finite component take no part; vectors of different length are
    multiplied over the components both have; rows that share the query's id are
    not its candidates; a repeated row counts each time; an empty vector scores
    0; an empty table gives no rows; other columns are ignored.
    """
    terms = vectors.select(F.col(id_col).cast("long").alias("id"), weights(F.col(vector_col)).alias("terms"), query.alias("asks")).where(F.col("id").isNotNull() & F.col("terms").isNotNull())
    # documents with the same strongest terms share blocks, so that their bounds are tight
    order = [F.array_position("terms", F.array_max("terms")), F.array_position("terms", F.array_min("terms")), "id"]
    terms = written(terms, "terms")
    n, asked = terms.agg(F.count(F.lit(1)), F.count_if(F.coalesce("asks", F.lit(False)))).first()
    slices, parts = max(1, math.ceil(n / (BLOCK_ROWS * SLICE_BLOCKS))), max(1, math.ceil(asked / QUERY_ROWS))
    number = F.monotonically_increasing_id()

    dealt = terms.repartitionByRange(slices, *order).sortWithinPartitions(*order).select("id", "terms")
    docs = written(dealt.mapInArrow(_packed(BLOCK_ROWS * SLICE_BLOCKS, True), SLICES).withColumn("slice", number), "blocks")
    dealt = terms.where("asks").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "terms")
    asks = written(dealt.mapInArrow(_packed(QUERY_ROWS, False), "dim int, ids binary, rows binary").withColumn("part", number), "queries")

    # every block of queries meets every slice of documents, in the slice's lane
    lane = F.pmod(F.xxhash64("slice"), F.lit(slices)).alias("lane")
    dealt = lambda rows: rows.repartition(slices, "lane")
    everywhere = lambda rows: dealt(rows.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))))
    summary = dealt(docs.select(lane, "slice", F.col("dim").alias("d_dim"), "high", "low"))
    reach = everywhere(asks.select("part", "dim", "rows")).join(summary, "lane")
    best = reach.mapInArrow(_best_block, "part bigint, at int, bound double, slice bigint, block int")
    best = best.groupBy("part", "at").agg(F.max_by(F.struct("slice", "block"), F.struct("bound", -F.col("slice"), -F.col("block"))).alias("b"))
    best = best.groupBy("part", "b.slice", "b.block").agg(F.collect_list("at").alias("at"))

    full = docs.select(lane, "slice", F.col("dim").alias("d_dim"), F.col("ids").alias("d_ids"), F.col("rows").alias("d_rows"), "high", "low")
    # only the chosen block travels on to the queries, not its slice
    wide = F.lit(8) * F.col("d_dim")
    block = lambda c, width: F.substring(c, (F.col("block") * width * BLOCK_ROWS + 1).cast("int"), (width * BLOCK_ROWS).cast("int")).alias(c)
    chosen = best.join(full.drop("lane", "high", "low"), "slice").select("part", "at", "d_dim", block("d_ids", F.lit(8)), block("d_rows", wide))
    first = chosen.join(asks, "part").mapInArrow(_first_kth(k), "part bigint, at int, kth bigint, last bigint")
    kths = first.groupBy("part").agg(F.collect_list(F.struct("at", "kth", "last")).alias("kths"))

    armed = written(asks.join(kths, "part", "left"), "armed")
    found = everywhere(armed).join(dealt(full), "lane").mapInArrow(_cells(k), "part bigint, at int, query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("part", "at").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
