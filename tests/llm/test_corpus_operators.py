"""Operators over all documents, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import components, decontamination, simhash, substring_dedup, topk, transcripts
from tests.llm.cases import ODD, SCHEMA, documents, frame, same, sentences

WORD = r"[^\x20\x09-\x0D]+"


# -- SimHash -------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits=3):
    fps = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits):
            root[find(int(j))] = find(i)
    least: dict[int, int] = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("limit", [1, 1024])
def test_simhash_components(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    rows = documents(2, 150) + ODD
    fps = [plain_fingerprint(t) for _, t in rows]
    want = [(i, f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, plain_components(fps, [i for i, _ in rows]))]
    assert same(simhash.simhash_components(frame(spark, rows, clashing=True)), want)


def test_simhash_matches_spark_hash(spark):
    shingle = "one two three"
    value = spark.range(1).select(F.xxhash64(F.lit(shingle)).alias("h")).first().h
    assert simhash.fingerprint(shingle.upper()) == value % (1 << 64)


def test_simhash_long_text_is_hashed_whole(monkeypatch):
    text = " ".join(documents(4, 3)[0][1].split() * 20)
    whole = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE_BYTES", 100)
    assert simhash.fingerprint(text) == whole


def test_lists_tally_and_flip_agree(monkeypatch):
    rng = np.random.default_rng(0)
    fps = np.unique(np.uint64(0x1234567890ABCDEF) ^ rng.integers(0, 2**24, 3000).astype(np.uint64))
    monkeypatch.setattr(simhash, "FLIP_FROM", 10**9)
    tallied = simhash.links_in_list(fps, 3, (0, 1, 2, 3, 4))
    monkeypatch.setattr(simhash, "FLIP_FROM", 0)
    flipped = simhash.links_in_list(fps, 3, (0, 1, 2, 3, 4))
    assert len(tallied[0]) > 100 and all((a == b).all() for a, b in zip(tallied, flipped))


def test_every_five_bytes_hold_a_triple():
    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in simhash.FIVES)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {(r.node, r.root) for r in components.components(edges).collect()}
    assert got == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}
    assert components.components(edges.where("a < 0")).count() == 0


@pytest.mark.parametrize("path", [[1, 3, 4, 5, 2], [2, 4, 3, 6, 5, 0, 1, 7], [1, 2, 0, 6, 4, 5, 3], [1, 4, 2, 3, 0, 5, 6]])
def test_components_of_a_path_in_any_order(spark, path):  # alone: other components keep the rounds going
    edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
    assert same(components.components(edges), [(x, min(path)) for x in path])


def drifting(seed, n=8):
    rng = np.random.default_rng(seed)
    fps = [int(rng.integers(0, 2**63))]
    while len(fps) < n:
        fps.append(fps[-1] ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    return fps


#: In the order 1-3-4-5-2; of each two steps no list of three bytes holds both.
CHAIN = [0x0000000000000000, 0x0400000001010000, 0x0601000003010000, 0x0701000003030100, 0x0303000007030100]


@pytest.mark.parametrize("fps", [CHAIN, drifting(0)])
def test_drifting_fingerprints_are_one_component(spark, monkeypatch, fps):
    import pyarrow as pa

    def given(words):
        def run(batches):  # the text is the fingerprint
            for b in batches:
                found = np.array([int(t.as_py(), 16) for t in b.column(1)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return run

    monkeypatch.setattr(simhash, "_fingerprints", given)
    rows = [((7 * i + 3) % len(fps), f"{fp:016x}") for i, fp in enumerate(fps)]
    want = [(i, text, 0) for i, text in rows]
    assert plain_components(fps, [i for i, _ in rows]) == [0] * len(fps)
    assert same(simhash.simhash_components(frame(spark, rows)), want)


# -- repeated passages -------------------------------------------------------------------


def plain_repeats(rows, size=50):
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in words:
        for p in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[p : p + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1) if i is not None else ():
            if least[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size,anchor", [(50, 12), (8, 3)])
def test_remove_repeats(spark, size, anchor):
    base = documents(6, 60)
    long = base[0][1].split()
    extra = [(501, base[1][1]), (501, base[2][1]), (501, base[2][1]), (502, " ".join(["a"] * 200)), (503, " ".join(["a"] * 120)), (504, " ".join(["a", "b"] * 90)), (505, " ".join(long * 3)), (None, base[3][1])]
    rows = base + ODD + extra
    want = plain_repeats(rows, size)
    assert sum(w[2] > 0 for w in want) > 10
    assert same(substring_dedup.remove_repeats(frame(spark, rows, clashing=True), size, anchor), want)


def test_window_digests_cost_what_is_asked(monkeypatch):
    """Power tables are made once a size, and the second half of a digest only where keys are compared in full."""
    summed, plain = [], substring_dedup._Rolling.__init__

    def init(self, hashes, base):
        summed.append(int(base))
        plain(self, hashes, base)

    monkeypatch.setattr(substring_dedup._Rolling, "__init__", init)
    words = [f"w{i % 90}".encode() for i in range(5000)]
    found = substring_dedup.Windows(words)
    every = np.arange(len(found.first))
    first = found.stretch_keys(every, 1)
    assert len(first) == 1 and summed == [int(substring_dedup._BASES[0])]
    whole = found.stretch_keys(every)
    assert len(whole) == 2 and len(summed) == 2 and (whole[0] == first[0]).all() and (whole[0] != whole[1]).all()
    for base in substring_dedup._BASES:
        up, down = substring_dedup._powers(base, 5000)
        assert substring_dedup._powers(base, 4000)[0] is up and int(up[77]) == pow(int(base), 77, 1 << 64)
        assert all((int(a) * int(b)) % (1 << 64) == 1 for a, b in zip(up[:5001:500], down[:5001:500]))
    starts = np.arange(found.n)
    for keys in found.window_keys(starts):
        assert (keys[:90] == keys[90:180]).all() and len(set(keys.tolist())) == 90


# -- decontamination ---------------------------------------------------------------------

QUESTION = "A train leaves the station with Alice at 60 km per hour while Bob waits 15 minutes and Alice reads 3 books before the next stop near Lyon today."
ITEMS = [(1, QUESTION), (2, "sum of 2 and 3 is what"), (3, "too short"), (None, "x y z w"), (4, None), (5, documents(8, 1)[0][1])]


def held(spark, rows, items=ITEMS):
    found = decontamination.find_leaks(frame(spark, rows, clashing=True), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)))
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_leaks(spark):
    swapped = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave Jones").replace("60 km", "75km").replace("15", "twenty")
    rows = [
        (10, "Intro. " + QUESTION + " Outro."), (11, "Intro. " + swapped), (12, QUESTION.replace("with Alice", "with Carol")), (13, "The sum of 7 and 8 is what"), (14, " ".join(QUESTION.split()[:10])),
        (15, documents(8, 1)[0][1]), (None, QUESTION), (16, None), (17, ""), (18, documents(9, 3)[2][1]), (10, "Intro. " + QUESTION + " Outro."),
    ]
    found = held(spark, rows)
    assert set(found) == {(10, 1), (11, 1), (12, 1), (13, 2), (15, 5)}
    assert found[(10, 1)].same_values and found[(10, 1)].share == 1 and not found[(11, 1)].same_values and found[(11, 1)].share == 1
    assert 0.5 <= found[(12, 1)].share < 1


def test_leaks_against_containment(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.item_id: " ".join(r.text.split()).lower() for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in " ".join((r.text or "").split()).lower()}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == want


def test_leaks_by_sentence_initial_names(spark):
    apples = "Alice has 12 apples in her basket. Bob has 7 apples in his bag. Carol has 3 pears in her box. How many apples do they have?"
    items = [(1, apples), (2, "What is the sum of 2 and 3"), (3, "Alice Smith took 3 of 4 left"), (4, "given that Peter runs, what is his speed after the start of it")]
    swapped = apples.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Fay")
    rows = [
        (1, "Before. " + swapped), (2, "as is known " + swapped + " and so on"), (3, "then he asked What is the sum of 2 and 3"), (4, "and what is the sum of 2 and 3"),
        (5, "she said Alice Smith took 3 of 4 left"), (6, "Alice Smith took 3 of 4 left"), (7, "Given that Peter runs. What is his speed after the start of it"), (8, "Alice has no apples in her basket. Bob left."),
    ]
    found = held(spark, rows, items)
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (7, 4)}
    assert all(found[k].share == 1 for k in found) and {k for k in found if not found[k].same_values} == {(1, 1), (2, 1)}


def test_leaks_of_excerpts_and_numbers(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    dense = "Compute 13 + 8 * 4 - 6 / 3 given 5 , 8 and 25 ."
    items = [(1, long), (2, dense)]
    words = long.split()
    rows = [
        (1, "before " + " ".join(words[10:38]) + " after"), (2, "before " + " ".join(words[10:29]) + " after"), (3, dense), (4, "Now: compute 17 + 9 * 2 - 4 / 7 given 6 , 9 and 31 . Go on."),
        (5, "Now: " + dense + " Go on with 5 of 8."), (6, "Compute 13 + 8 * 4 and 25"), (7, " ".join(words[5:14]) + " between " + " ".join(words[20:29])), (8, "13 8 4 6 3 5 8 25 " * 40),
    ]
    assert {k: v.same_values for k, v in held(spark, rows, items).items()} == {(1, 1): True, (3, 2): True, (4, 2): False, (5, 2): True}


def test_leaks_only_over_words_of_items(monkeypatch):
    """Words are looked up once for many documents, and windows over a word that no item has are not hashed."""
    passage = "each of the old boats was painted by hand in the spring"
    texts = [f"{passage} z{i} " + " ".join(f"x{i}y{j}" for j in range(200)) for i in range(50)]
    word, window = np.zeros(decontamination.WORD_BITS, dtype=bool), np.ones(decontamination.FILTER_BITS, dtype=bool)
    for rows in decontamination._listed([pa.RecordBatch.from_pydict({"id": [1], "text": [passage]})]):
        word[rows.column(0).to_numpy()] = True
    assert 0 < word.sum() <= len(passage.split())
    hashed, asked, mixed, of = [], [], decontamination._mixed, decontamination._Tokens.of
    monkeypatch.setattr(decontamination, "_mixed", lambda tokens, size: hashed.append(len(tokens[0])) or mixed(tokens, size))
    monkeypatch.setattr(decontamination._Tokens, "of", lambda self, words: asked.append(len(words)) or of(self, words))
    run = decontamination._document_windows(8, [8], *(np.packbits(x).tobytes() for x in (window, word)))
    (found,) = run([pa.RecordBatch.from_pydict({"id": list(range(50)), "text": texts})])
    windows = len(passage.split()) - 8 + 1
    assert found.column("id").to_pylist() == [i for i in range(50) for _ in range(windows)] and found.column("at").to_pylist() == list(range(windows)) * 50
    assert sum(hashed) <= 50 * (windows + 3) and asked == [len({w for t in texts for w in t.split()})]


def test_leaks_of_texts_side_by_side(spark, monkeypatch):
    """Texts that are looked at together stay apart, whether they share a chunk or not."""
    half = len(QUESTION) // 2 + QUESTION[len(QUESTION) // 2 :].index(" ")
    texts = [QUESTION, QUESTION[:half], QUESTION[half:], "", "  ", "x", "at 60", "km " + QUESTION, QUESTION[half:], QUESTION[:half], "ends with Alice", "Bob " + QUESTION]
    ids = [pa.array(range(len(texts)), pa.int64()), pa.array(texts)]
    items = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([QUESTION])], ["id", "text"])
    full = [np.packbits(np.ones(n, dtype=bool)).tobytes() for n in (decontamination.FILTER_BITS, decontamination.WORD_BITS)]
    want = {h for x in decontamination._item_windows(8)([items]) for h in x.column("h").to_pylist()}

    def rows(run, batches):
        return sorted((i, at, h, tuple(slots)) for x in run(batches) for i, at, h, slots in zip(*(x.column(c).to_pylist() for c in ("id", "at", "h", "slots"))) if h in want)

    alone = rows(decontamination._document_windows(8, [8], *full), [pa.RecordBatch.from_arrays([x.slice(i, 1) for x in ids], ["id", "text"]) for i in range(len(texts))])
    for size in (1, 150, 1 << 22):
        monkeypatch.setattr(decontamination, "CHUNK", size)
        assert rows(decontamination._document_windows(8, [8], *full), [pa.RecordBatch.from_arrays(ids, ["id", "text"])]) == alone
    assert set(held(spark, list(enumerate(texts)), [(1, QUESTION)])) == {(0, 1), (7, 1), (11, 1)}


def test_leaks_of_nothing(spark):
    assert not held(spark, [(1, QUESTION)], [(None, None)]) and not held(spark, [(None, None)])
    none = spark.createDataFrame([], SCHEMA)
    assert decontamination.find_leaks(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# -- top-k -----------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.1, (300, 16)))]
    rows += [(None, [1.0] * 16), (1000, None), (1020, [float("nan")] * 16), (1040, [None] * 16), (1060, [0.5] * 16), (1061, [0.5] * 16), (1080, [1e9] * 16), (1081, [float("inf")] * 16), (1100, []), (1120, [0.25] * 8)]
    rows += [(2000 + i, [0.3] * 16) for i in range(30)] + [(2000, [0.3] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("part", F.lit("x"))
    clean = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in clean:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in clean if j != i)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert same(topk.top_k(df, F.col("vec_id") % 20 == 0), want)
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 40, (8, 16))
    rows = np.repeat(np.arange(8), topk.BLOCK_ROWS)
    docs = np.floor(centres[rows] + rng.normal(0, 1, (len(rows), 16))).astype(np.int64)
    high = np.stack([docs[i : i + topk.BLOCK_ROWS].max(0) for i in range(0, len(docs), topk.BLOCK_ROWS)])
    low = np.stack([docs[i : i + topk.BLOCK_ROWS].min(0) for i in range(0, len(docs), topk.BLOCK_ROWS)])
    ids, queries = np.arange(len(docs)), docs[:: topk.BLOCK_ROWS]
    q, found, scores, scored = topk.top_in_blocks(queries, ids[:: topk.BLOCK_ROWS], np.full(8, np.iinfo(np.int64).min), np.full(8, np.iinfo(np.int64).max), docs, ids, high, low, 5)
    assert scored < 0.6 * len(queries) * len(docs)
    for i in range(8):
        all_scores = docs @ queries[i]
        order = [j for j in np.lexsort((ids, -all_scores)) if j != i * topk.BLOCK_ROWS][:5]
        assert found[q == i].tolist() == [int(ids[j]) for j in order] and scores[q == i].tolist() == all_scores[order].tolist()


# -- chat ---------------------------------------------------------------------------------------


def test_chat_roles(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = transcripts.as_transcripts(turns)
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(transcripts.STYLES)))
    found = transcripts.chat_format(turns).withColumn("style", style).groupBy("style").agg((F.sum("n_right") / F.sum("n_lines")).alias("share")).collect()
    assert whole.count() == turns.select("conv_id").distinct().count()
    share = {r.style: r.share for r in found}
    assert all(share[s] > 0.97 for s in (0, 1, 2) if s in share) and all(x > 0.6 for x in share.values()), share


def test_chat_parsing():
    model = transcripts.RoleModel(np.array([3, 7, 0.0]), np.array([[0, 9, 0], [0, 0, 9], [0, 9, 0.0]]), np.ones((3, 2)), np.ones((3, transcripts.LENGTHS, 2)))
    turns, lines = transcripts.parse("System: be kind\nUser: hi\nthere\n\nAssistant: hello: you\nUser: bye", model)
    assert turns == [("system", "be kind"), ("user", "hi\nthere"), ("assistant", "hello: you"), ("user", "bye")]
    assert lines == ["system", "user", "user", "assistant", "user"]
    turns, _ = transcripts.parse("Maria: how are you?\nJonas: fine\nMaria: good", model)
    assert [r for r, _ in turns] == ["user", "assistant", "user"]
    assert transcripts.rendered([("user", "x")]) == "<|user|>\nx\n<|end|>"
    assert transcripts.parse("", model) == ([], []) and transcripts.parse(" \n ", model) == ([], [])


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(1)
    model = transcripts.RoleModel(rng.random(3), rng.random((3, 3)), rng.random((3, 2)), rng.random((3, transcripts.LENGTHS, 2)))
    markers, blank, length, asks = rng.integers(0, 5, 4), rng.integers(0, 2, 4), rng.integers(0, transcripts.LENGTHS, 4), rng.integers(0, 2, 4)

    def score(path):
        total = model.start[path[0]]
        for i, s in enumerate(path):
            r, on = s % 3, s // 3
            total += (transcripts._ON if on else transcripts._BEGIN)[r, markers[i]] + transcripts._BLANK[on, blank[i]] + model.shape[r, length[i], asks[i]]
            total += model.step[path[i - 1], s] if i else 0
        return total

    best = max(product(range(6), repeat=4), key=score)
    assert abs(score(best) - score(model.decode(markers, blank, length, asks, True).tolist())) < 1e-9


def test_speaker_names(spark):
    model = transcripts.fit_roles(spark.createDataFrame([(1, 0, "user", "hello?"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string"))
    turns, _ = transcripts.parse("Dr Anna Maria Smith: hello?\nJonas: yes\nDr Anna Maria Smith: more?\nJonas: no", model)
    assert [c for _, c in turns] == ["hello?", "yes", "more?", "no"] and turns[0][0] == turns[2][0] != turns[1][0] == turns[3][0]
    turns, _ = transcripts.parse("User: hello\n\nNote: remember this", model)
    assert "Note: remember this" in "\n".join(c for _, c in turns)


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "y"), (2, None, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b"), (3, 5000, "assistant", "late"), (3, 0, "user", "early"), (4, 0, "other", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("p")).withColumn("turns", F.lit(1))
    got = {(r.conv_id, r.part): r for r in transcripts.chat_format(df).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 0)}  # parts are counted turns, whatever their numbers
    assert got[(3, 0)].rendered.index("early") < got[(3, 0)].rendered.index("late")
    many = [(1, 1000 * i, ("user", "assistant")[i % 2], f"turn {i}?" if i % 2 == 0 else f"answer {i}") for i in range(2 * transcripts.PART_TURNS + 3)] + [(1, None, "system", "first of all")]
    long = spark.createDataFrame(many, "conv_id long, turn long, role string, text string")
    parts = {r.part: r.stored for r in transcripts.as_transcripts(long).collect()}
    assert {k: len(v) for k, v in parts.items()} == {0: transcripts.PART_TURNS, 1: transcripts.PART_TURNS, 2: 4} and parts[0][0] == "system"
    assert transcripts.chat_format(df.where("conv_id < 0")).count() == 0


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        stage(spark, table, sf_dir).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        assert table.columns == docs.columns and table.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        counts.append(table.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    want = {tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want and len(want) == counts[4]
    assert not [r for r in table.collect() if "[SECRET]" not in r.text and re.search(r"token = \"[0-9a-f]{40}\"", r.text)]


def test_pipeline_keeps_one_of_each_group(spark):
    rows = documents(2, 80) + ODD
    df = frame(spark, rows, clashing=True)
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    groups = simhash.simhash_components(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({g.component_id for g in groups if g.component_id is not None})
    assert sum(r.doc_id is None for r in kept) == 1 and kept[0].__fields__ == df.columns


def test_pipeline_groups_rows_of_one_id_apart(spark):
    alone, shared, twice, other = (sentences(random.Random(i), 200) for i in range(4))
    # 5: one text that is its own, and the longer one that 1 holds as well; 7: two texts, the first twice
    rows = [(1, shared), (5, alone), (5, shared + "\n" * 2000), (7, twice), (7, twice), (7, other)]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows, clashing=True), "").collect()
    groups = {(g.doc_id, g.component_id) for g in simhash.simhash_components(frame(spark, rows)).collect()}
    assert (5, 1) in groups and (5, 5) in groups
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, shared), (5, alone), (7, twice), (7, other)])


def test_pipeline_drops_rows_and_not_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    clean = sentences(random.Random(9), 80)
    rows = [(1, clean), (1, f"{clean} {item}"), (None, item), (None, clean), (2, None), (3, clean), (3, clean)]
    df = frame(spark, rows, clashing=True).withColumn("_row", F.lit("x"))
    kept = corpus_pipeline.decontamination(spark, df, sf_dir)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, clean), (None, clean), (2, None), (3, clean), (3, clean)], key=str)


def test_pipeline_edges(spark, sf_dir):
    for rows in ([], ODD):
        docs = frame(spark, rows, clashing=True)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
