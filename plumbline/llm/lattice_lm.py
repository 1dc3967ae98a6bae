"""Document probabilities from word counts and a lattice of subwords.

A word costs what its count allows, plus what all its segmentations into pieces
of an existing vocabulary allow together: a forward recursion over the bytes of
the word adds up every path in log space. The vocabulary's own scores weight the
pieces; the share of the lattice against the counts is learned from the training
documents. As no piece reaches over white space, a document's probability is the
product over its words, and each distinct word meets the lattice once.

Tasks cut their documents into chunks of a bounded size, each with its distinct
words. Only these words are shuffled, to be counted over all documents and
scored, and their numbers return to their chunk.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import written

#: Bytes of text in a chunk (or one document that is longer), and of a slice of it that is split at once.
CHUNK_BYTES, SLICE_BYTES = 16_000_000, 2_000_000
#: Scored words that a task holds before it sends them back, packed by chunk.
PACK_WORDS = 1_000_000
#: What ends a document; no word is empty.
END = b""
#: Mark of a piece that starts a word, in the vocabulary file.
START = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")

CHUNKS = "words array<binary>, counts array<bigint>, docs array<bigint>, held array<boolean>, sizes array<bigint>, ids binary"
SCORED = "chunk bigint, at binary, c binary, sub binary, n bigint, words bigint, once bigint"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

_SPACE = re.compile(rb"[\x20\t-\r]")


# -- the lattice ------------------------------------------------------------------------


class Lattice:
    """Pieces of a vocabulary with natural-log weights: those that start a word, and those within it or ending it.

    Both sets of weights sum to 1 with what ends a word, so that the words'
    probabilities do. Every byte is a piece of its own, so that no word is out of
    reach.
    """

    def __init__(self, scores: dict[str, float]):
        # the file's scores are ranks below zero; a piece of rank r weighs as 1 / r, the law of word frequencies
        whole = {x: s for x, s in scores.items() if not BYTE.fullmatch(x) and s > -1e8}
        last = max((-s for s in whole.values()), default=0.0) + 2
        singles = {bytes([b]): 1 / last for b in range(256) if not bytes([b]).isspace() and not bytes([b]).isupper()}
        # pieces that no word in lower case can hold take no weight
        weigh = lambda found: singles | {x.encode(): 1 / (1 - min(0.0, s)) for x, s in found.items() if x.encode().lower().split() == [x.encode()]}
        first = weigh({x[len(START) :]: s for x, s in whole.items() if x.startswith(START)})
        later = weigh({x: s for x, s in whole.items() if START not in x})
        end = sum(later.values()) / 2  # a third of the steps within a word end it
        self.first = {x: math.log(w / sum(first.values())) for x, w in first.items()}
        rest = sum(later.values()) + end
        self.later, self.end = {x: math.log(w / rest) for x, w in later.items()}, math.log(end / rest)
        self.ends = {x[n:] for x in (*self.first, *self.later) for n in range(len(x))}
        self.longest = max(map(len, self.ends))

    def log_probabilities(self, words: list[bytes]) -> Iterator[float]:
        """Natural log of the sum over all segmentations of each word.

        What arrives at a byte depends on the bytes before it alone, so sorted
        words share the recursion over their common beginnings.
        """
        first, later, ends, longest = self.first, self.later, self.ends, self.longest
        last, arrived = b"", [0.0]
        for word in words:
            n = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                n += 1
            del arrived[n + 1 :]
            for j in range(n + 1, len(word) + 1):
                logs, i = [], j - 1
                while i > 0 and i >= j - longest:
                    piece = word[i:j]
                    if piece not in ends:
                        break
                    if piece in later:
                        logs.append(arrived[i] + later[piece])
                    i -= 1
                else:
                    if i == 0 and word[:j] in first:
                        logs.append(first[word[:j]])
                arrived.append(_added(logs))
            last = word
            yield arrived[-1] + self.end


def _added(logs: list[float]) -> float:
    """Log of the sum of exponentials."""
    if len(logs) == 1:
        return logs[0]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


@lru_cache(2)
def read_lattice(path: str) -> Lattice:
    """The lattice of a vocabulary file with scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Lattice({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))})


# -- chunks -----------------------------------------------------------------------------


def _slices(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > SLICE_BYTES and (cut := _SPACE.search(raw, start + SLICE_BYTES)):
        yield raw[start : cut.start()]
        start = cut.start()
    yield raw[start:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents ``doc_id, text, held`` as chunks: distinct words with training counts, and documents as numbers of words."""

    def chunk(seen: dict, docs: list, held: list, ids: list) -> pa.RecordBatch:
        sizes = [len(x) for x in ids]
        flat = np.concatenate(ids)
        trained = np.repeat(~np.array(held, dtype=bool), sizes)
        counts = np.bincount(flat[trained], minlength=len(seen))
        columns = [
            pa.array([list(seen)], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())),
            pa.array([docs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pa.compress(flat.astype(np.int32), codec="zstd", asbytes=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["words", "counts", "docs", "held", "sizes", "ids"])

    seen, docs, held, ids, size = {}, [], [], [], 0
    for batch in batches:
        for doc, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if docs and size + len(raw) > CHUNK_BYTES:
                yield chunk(seen, docs, held, ids)
                seen, docs, held, ids, size = {}, [], [], [], 0
            parts = []
            for part in _slices(raw):
                words = part.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
                parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int32))
            parts.append(np.array([seen.setdefault(END, len(seen))], dtype=np.int32))
            docs.append(doc)
            held.append(out)
            ids.append(np.concatenate(parts))
            size += len(raw)
    if docs:
        yield chunk(seen, docs, held, ids)


def _scored(path: str):
    """Rows ``chunk, at, word, c``, sorted by word, to packed rows of a chunk; each distinct word meets the lattice once.

    ``n, words, once`` of all rows add up to the training tokens, the distinct
    words among them, and those that occur once.
    """

    def packed(held: list[np.ndarray], about: list[int]) -> pa.RecordBatch:
        chunk, at, c, sub = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, chunk))
        chunk, at, c, sub = chunk[order], at[order], c[order], sub[order]
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        cut = lambda x: pa.array([part.tobytes() for part in np.split(x, starts[1:])], pa.binary())
        sums = [pa.array([x] + [0] * (len(starts) - 1), pa.int64()) for x in about]
        return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), cut(at), cut(c), cut(sub), *sums], ["chunk", "at", "c", "sub", "n", "words", "once"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, last, value = read_lattice(path), None, 0.0
        held, size, about = [], 0, [0, 0, 0]
        for batch in batches:
            words = batch.column(2).to_pylist()
            first = np.array([word != before for word, before in zip(words, [last, *words])], dtype=bool)
            new = np.flatnonzero(first)
            values = np.r_[value, list(lattice.log_probabilities([words[i] for i in new]))]
            values[1:][[words[i] == END for i in new]] = -math.inf  # no word of the lattice
            if words:
                last, value = words[-1], values[-1]
            c = batch.column(3).to_numpy()
            about = [about[0] + int(c[new].sum()), about[1] + int((c[new] > 0).sum()), about[2] + int((c[new] == 1).sum())]
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), c, values[np.cumsum(first)]))
            size += len(words)
            if size >= PACK_WORDS:
                yield packed(held, about)
                held, size, about = [], 0, [0, 0, 0]
        if size:
            yield packed(held, about)

    return run


# -- scores -----------------------------------------------------------------------------


def word_scores(c: np.ndarray, sub: np.ndarray, n: int, words: int, once: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of every word in the base model and in this one.

    A seen word keeps its count but for a discount, the share of words seen once;
    what all discounts free goes to the lattice, which every word can be read from.
    """
    base = np.log10(c + 1.0) - math.log10(n + words + 1)
    if not n:
        return base, np.where(np.isneginf(sub), 0.0, sub / math.log(10))  # nothing learned: the lattice alone, and documents end for sure
    discount = min(0.95, max(0.05, once / words))
    # the end of documents is always seen, and no word of the lattice: what it gives up goes there too
    seen = np.log(np.maximum(c - discount, 1e-300)) - math.log(n)
    spelled = math.log(discount * words / n) + sub
    score = np.where(c > 0, np.logaddexp(seen, spelled), spelled)
    return base, score / math.log(10)


def _documents(n: int, words: int, once: int):
    """The packed words of a chunk, then the chunk itself; documents out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            for i, whole in enumerate(batch.column("kind").to_pylist()):
                parts.append(batch.slice(i, 1))
                if whole:
                    yield documents(parts[:-1], parts[-1])
                    parts = []

    def documents(parts: list[pa.RecordBatch], row: pa.RecordBatch) -> pa.RecordBatch:
        read = lambda x, kind: np.concatenate([np.frombuffer(p.column(x)[0].as_buffer(), dtype=kind) for p in parts])
        at, c, sub = read("at", np.int32), read("c", np.int64), read("sub", np.float64)
        order = np.argsort(at)
        base, score = word_scores(c[order], sub[order], n, words, once)
        docs, held, sizes = (row.column(x)[0].values for x in ("docs", "held", "sizes"))
        ids = np.frombuffer(pa.decompress(row.column("ids")[0].as_buffer(), 4 * pc.sum(sizes).as_py(), codec="zstd"), dtype=np.int32)
        starts = np.r_[0, np.cumsum(sizes.to_numpy())[:-1]]
        total = lambda x: np.add.reduceat(x[ids], starts)  # noqa: E731  every document has its end
        known = total((c[order] > 0).astype(np.int64))
        columns = [docs, held, sizes, pa.array(known), pa.array(np.full(len(sizes), n, dtype=np.int64)), pa.array(total(base)), pa.array(total(score))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lattice_scores(docs: DataFrame, held_out: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are the text's words, A-Z in lower case, and one end. Counts come from
    the rows where ``held_out`` does not hold (a null counts as not held out).
    ``base_score`` adds up log10((c + 1) / (N + V + 1)); ``score`` is the log10
    probability of the text by counts and lattice. A null text is empty: its end
    alone; a null id stays null; a repeated row counts and is scored each time; an
    end never seen in training is certain in ``score``; an empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = written(rows.mapInArrow(_chunks, CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "chunks")

    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    words = words.select("chunk", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    # a word has a row a chunk: no word, however frequent, has more than that
    total = F.sum("n").over(W.partitionBy("word"))
    counted = words.select("chunk", "at", "word", total.alias("c")).sortWithinPartitions("word")
    scored = written(counted.mapInArrow(_scored(path), SCORED), "words")

    about = scored.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "words", "once")]).first()

    columns = dict(field.split(" ") for field in f"{CHUNKS}, at binary, c binary, sub binary".split(", "))
    side = lambda rows, kind: rows.select("chunk", F.lit(kind).alias("kind"), *[F.col(x) if x in rows.columns else F.lit(None).cast(t).alias(x) for x, t in columns.items() if x not in ("words", "counts")])
    left, right = side(scored, 0), side(chunks, 1)
    dealt = left.unionByName(right).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(_documents(about["n"], about["words"], about["once"]), RESULT)
