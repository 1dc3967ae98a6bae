"""Word counts and the subword lattice against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lattice_lm as op
from tests.llm.cases import ODD, documents, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
HELD = "crc32(cast(doc_id as string)) % 7 = 2"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def segmentations(word, pieces, later):
    """Probability of every way to read ``word``, one after another."""
    if not word:
        yield 1.0
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], later, later):
                yield math.exp(pieces[word[:n]]) * rest


def test_lattice_adds_up_all_segmentations():
    lattice = op.read_lattice(PATH)
    words = [w.encode() for w in ("a", "the", "there", "thereof", "naïve", "日本", "x=\x00", "éé", "running", "runner")]
    found = list(lattice.log_probabilities(words))
    for word, got in zip(words, found):
        want = math.fsum(segmentations(word, lattice.first, lattice.later)) * math.exp(lattice.end)
        assert math.isclose(got, math.log(want), rel_tol=1e-12), word
    # shared beginnings change nothing, in any order
    assert list(lattice.log_probabilities(sorted(words))) == [x for _, x in sorted(zip(words, found))]


def test_lattice_weights_are_probabilities():
    lattice = op.read_lattice(PATH)
    assert math.isclose(sum(map(math.exp, lattice.first.values())), 1)
    assert math.isclose(sum(map(math.exp, lattice.later.values())) + math.exp(lattice.end), 1)
    # the file's scores order the pieces
    assert lattice.later[b"in"] > lattice.later[b"om"] > lattice.later[b"\xff"]


def test_words_of_a_small_vocabulary_sum_to_one():
    lattice = op.Lattice({"▁a": -1, "▁ab": -2, "a": -3, "b": -4, "ba": -5})
    lattice.first = {k: v for k, v in lattice.first.items() if k in (b"a", b"ab")}
    kept = {k: v for k, v in lattice.later.items() if k in (b"a", b"b", b"ba")}
    scale = math.log(sum(map(math.exp, kept.values())) + math.exp(lattice.end))
    lattice.later, lattice.end = {k: v - scale for k, v in kept.items()}, lattice.end - scale
    scale = math.log(sum(map(math.exp, lattice.first.values())))
    lattice.first = {k: v - scale for k, v in lattice.first.items()}
    words, grown = [], [b"a"]
    for _ in range(13):
        words += grown
        grown = [w + x for w in grown for x in (b"a", b"b")]
    total = sum(map(math.exp, lattice.log_probabilities(words)))
    assert 0.9 < total < 1


def plain(rows):
    train = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    lattice = op.read_lattice(PATH)
    seen = sorted({t for _, text in rows for t in tokens(text) if t})
    spelled = dict(zip(seen, lattice.log_probabilities([t.encode() for t in seen])))
    discount = min(0.95, max(0.05, sum(c == 1 for c in train.values()) / v))

    def score(t):
        p = max(0.0, train[t] - discount) / n
        if t is not None:
            p += discount * v / n * math.exp(spelled[t]) if spelled[t] > -600 else 0.0
        return math.log10(p) if p else (math.log(discount * v / n) + spelled[t]) / math.log(10)

    for i, text in rows:
        ts = tokens(text)
        base = math.fsum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts)
        yield (i, held(i), len(ts), sum(train[t] > 0 for t in ts), n), (base, math.fsum(map(score, ts)))


@pytest.mark.parametrize("size", [300, 8_000_000])
def test_lattice_scores(spark, monkeypatch, size):
    monkeypatch.setattr(op, "CHUNK_BYTES", size)
    monkeypatch.setattr(op, "SLICE_BYTES", size // 4)
    rng = random.Random(9)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta\t"]) + str(rng.randrange(40)) for _ in range(30_000))
    rows = documents(4, 60) + ODD + [(2000, long), (2001, "rare " * 5000), (2002, "z" * 20_000)]
    found = op.lattice_scores(frame(spark, rows, clashing=True), F.expr(HELD), PATH)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda x: (x[0][0] is None, x[0][0] or 0, x[0], x[1])
    got = sorted(((tuple(r)[:5], tuple(r)[5:]) for r in found.collect()), key=key)
    want = sorted(plain(rows), key=key)
    assert [a for a, _ in got] == [a for a, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b))


def test_held_out_words_go_to_the_lattice(spark):
    """A word that training lacks is scored by its pieces: likelier where they are common."""
    train = [(i, "the cat sat on the mat") for i in range(20) if not held(i)]
    i = next(i for i in range(50) if held(i))
    rows = train + [(i, "the there"), (i, "the qxjzk"), (i, "the the")]
    found = op.lattice_scores(frame(spark, rows), F.expr(HELD), PATH).where("held_out").orderBy(F.desc("score")).collect()
    assert [r["n_known"] for r in found] == [3, 2, 2]
    assert found[1]["score"] > found[2]["score"]


def test_nothing_to_learn_from(spark):
    assert op.lattice_scores(frame(spark, []), F.expr(HELD), PATH).collect() == []
    row, = op.lattice_scores(frame(spark, [(1, None)]), F.lit(True), PATH).collect()
    assert tuple(row) == (1, True, 1, 0, 0, 0.0, 0.0)
    row, = op.lattice_scores(frame(spark, [(1, "ab")]), F.lit(True), PATH).collect()
    want, = op.read_lattice(PATH).log_probabilities([b"ab"])
    assert math.isclose(row["score"], want / math.log(10))
