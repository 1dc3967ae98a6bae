"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth long, conv long, names string, up string"


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest(), r, t))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(who) - 1) * words
            leaves[s[:d]] += s not in kids
    out = []
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(s))
        out.append((min(who), len(s), min(members[s[:-1]]) if s else None, len(who), kids.get(s, 0), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=90, longest=14):
    rng = random.Random(seed)
    rows, made = [], []
    for c in range(-25, n):
        if made and rng.random() < 0.5:
            turns = list(rng.choice(made))
            turns = turns[: rng.randint(1, len(turns))] + [("user", rng.choice("abc") * 2)] * rng.randint(0, 2)
        else:
            turns = [(rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(1, longest))]
        made.append(turns)
        order = list(enumerate(turns))
        rng.shuffle(order)
        rows += [(c, 1000 * i, r, t) for i, (r, t) in order]
    rows = [r for r in rows if r[0] != 40]  # a base that is missing
    odd = [(None, 0, "user", "x"), (500, None, None, None), (500, None, None, None), (500, 0, "", " \t\n"), (501, 3, "user", "a"), (501, 3, "assistant", "b"), (520, -1, "user", "é　e"),
           (521, 2, "user", "word " * 30_000), (521, 3, "user", "word " * 30_000), (-7, 5, "user", None)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 0, 0, None, None) for r in rows], SCHEMA)


def found(spark, rows, rebuild=True):
    conv = F.col("conv")
    df = op.prefix_trie(frame(spark, rows), *([F.crc32(conv.cast("string")) % 4, conv - conv % 20] if rebuild else []))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [4, 256])
def test_prefix_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    monkeypatch.setattr(op, "TEXT_IDS", 3)
    rows = conversations(2) + [(600, i, "user", "same") for i in range(41)] + [(601, i, "user", "same" if i < 37 else "other") for i in range(45)]
    assert found(spark, rows) == sorted(plain(rows), key=repr)


def test_without_rebuilding(spark):
    rows = conversations(3, 30)
    assert found(spark, rows, False) == sorted(plain(rows, False), key=repr)


def test_hot_conversation(spark, monkeypatch):
    """Many copies of a conversation, and one that holds a third of all rows."""
    monkeypatch.setattr(op, "TEXT_IDS", 100)
    rows = [(c, i, "user", f"hot {i}") for c in range(700) for i in range(2)] + [(9000, i, "user", f"long {i % 3}") for i in range(700)]
    assert found(spark, rows, False) == sorted(plain(rows, False), key=repr)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    # the base is absent and takes its turns with it
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(spark, [(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_names_of_prefixes_share_their_context():
    """The recursion names equal prefixes equally, whatever follows and wherever a chunk is cut."""
    contents = [op._digest(b"t", b"", bytes([i])) for i in range(21)]
    whole = op.name_prefixes(op.ROOT, contents)
    assert len(set(whole)) == 21
    assert all(op.name_prefixes(op.ROOT, contents[:n]) == whole[:n] for n in range(1, 22))
    cut = op._digest(b"c", op.ROOT, op.block_name(contents[:16]))
    assert op.name_prefixes(cut, contents[16:]) == whole[16:]
    changed = [contents[1], *contents[1:]]
    assert not set(op.name_prefixes(op.ROOT, changed)) & set(whole)
