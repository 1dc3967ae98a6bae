"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, terms long, at long, id long, positives string"


def plain(rows, anchors, positives=5, negatives=3, low=50, high=95):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, t, label in kept:
        if a % anchors:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(t, u))), i, other == label) for i, u, other in kept if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, m) for n, m, same in scored if not same and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, r + 1, m, -s, -n) for r, (n, m) in enumerate(fit)]
    return out


def vectors(seed, n=160, dims=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dims)]
        if rows and rng.random() < 0.3:
            v = list(rng.choice(rows)[1])  # ties
        rows.append((i, v, rng.randrange(3)))
    odd = [(None, [1.0] * dims, 1), (500, None, 1), (505, [1.0, None], 1), (510, [1.0] * dims, None), (515, [float("nan")] * dims, 2), (520, [float("inf")], 0),
           (525, [], 1), (530, [2.0], 1), (535, [1.0] * (dims + 3), 2), (rows[10][0], rows[10][1], rows[10][2]), (rows[11][0], rows[12][1], 1)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def same(df, want):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("tile", [1, 10_000])
def test_hard_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(op, "TILE_ANCHORS", max(4, tile // 100))
    monkeypatch.setattr(op, "LANE_ROWS", 20 * tile)
    monkeypatch.setattr(op, "BLOCK_SCORES", 50 * tile)
    rows = vectors(3)
    got = op.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, F.col("label"))
    want = plain(rows, 5)
    assert len(want) > 100
    same(got, want)


def test_large_components(spark):
    """Sums beyond 24 and beyond 64 bits stay exact, or at the ends."""
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 10.0 ** (3 * (i % 4))))) for _ in range(5)], i % 2) for i in range(60)]
    same(op.hard_negatives(frame(spark, rows), F.col("vec_id") % 3 == 0, F.col("label")), plain(rows, 3))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 3), (64, 160), (300, 2**20), (2500, 300), (7, 2**62), (0, 1)):
        a, b = rng.integers(-most, most, (9, dims), endpoint=True), rng.integers(-most, most, (11, dims), endpoint=True)
        primes = op.moduli(dims, dims * most * most)
        assert len(set(primes)) == len(primes) and all(all(p % d for d in range(2, math.isqrt(p) + 1)) for p in primes)
        assert all(min(max(dims, 1), op.SPAN) * (p // 2) ** 2 <= op.EXACT for p in primes)
        want = np.clip(a.astype(object) @ b.T.astype(object), op.LEAST, op.MOST) if dims else np.zeros((9, 11))
        assert (op.products(op.residues(a, primes), op.residues(b, primes), primes) == want).all()


def test_matrix_of_uneven_lists():
    lists = pa.array([[1], [9, 8, 7], [], [2, 3]], pa.list_(pa.int64()))
    assert op.matrix(lists.slice(1), 3).tolist() == [[9, 8, 7], [0, 0, 0], [2, 3, 0]]


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, [], 1), (2, [], 2)]):
        found = op.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, F.col("label"))
        assert found.collect() == []
