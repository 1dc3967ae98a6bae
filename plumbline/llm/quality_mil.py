"""Quality of whole documents by attention over their passages.

A document is a bag of passages of a fixed number of words. Every passage is
described by its characters and words (no language, source or id), encoded by
one layer, weighted by gated attention, and the weighted mean is scored. The
weights are learned from labels of documents alone; a few noisy passages can
so decide about a long text, and a score still comes from all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import give_back

PASSAGE_WORDS = 48
#: The fit uses at most this many labelled rows of each class, those with the smallest hashes.
SAMPLE_ROWS = 2500
#: Rows longer than this take no part in the fit (they are scored like all others).
SAMPLE_CHARS = 100_000
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
#: Bytes of text that a task describes at once.
GROUP_BYTES = 1_000_000

RESULT = "doc_id bigint, held_out boolean, score double, predicted int"

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _BANG, _BAR, _MARK, _QUOTE, _OTHER, _WIDE = range(11)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.int64)
    for chars, kind in ((b" \t\n\r\x0b\x0c", _SPACE), (bytes(range(97, 123)), _LOWER), (bytes(range(65, 91)), _UPPER), (b"0123456789", _DIGIT), (b".,;:", _STOP),
                        (b"!?", _BANG), (b"|", _BAR), (b"*#$%&@~^+=_<>\\/{}[]", _MARK), (b"'\"()-", _QUOTE)):
        table[list(chars)] = kind
    table[128:] = _WIDE
    return table


_CLASS = _classes()
_LETTER = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 2**63, 64).astype(np.uint64) | np.uint64(1)
N_FEATURES = 20


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the first passage of each text.

    A text without words has one passage of zeros but for its mark.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = _CLASS[raw]
    inside = kind != _SPACE
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    words = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    bags = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(bags)[:-1]])
    out = np.zeros((int(bags.sum()), N_FEATURES), dtype=np.float32)
    out[:, 0] = 1.0
    if not len(starts):
        return out, first
    place = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    bag = np.repeat(first, words) + place // PASSAGE_WORDS
    heads = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
    full = bag[heads]
    n = np.diff(np.concatenate([heads, [len(starts)]])).astype(np.float64)
    # bytes of a class per passage
    a, b = starts[heads], stops[np.concatenate([heads[1:], [len(starts)]]) - 1]
    span = np.repeat(np.arange(len(heads)), b - a)
    chars = kind[np.arange(len(span)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
    counts = np.bincount(span * 11 + chars, minlength=11 * len(heads)).reshape(-1, 11).astype(np.float64)
    size = np.maximum(counts[:, 1:].sum(1), 1)
    # words as numbers: the same letters at the same places
    letters_of = stops - starts
    at = np.arange(int(letters_of.sum())) - np.repeat(np.cumsum(letters_of) - letters_of, letters_of)
    value = _LETTER[raw[inside]] * _PLACE[at & 63]
    code = np.add.reduceat(value, np.cumsum(letters_of) - letters_of)
    order = np.lexsort((code, bag))
    fresh = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (bag[order][1:] != bag[order][:-1])])
    distinct = np.add.reduceat(fresh.astype(np.float64), heads)
    run = np.diff(np.concatenate([np.flatnonzero(fresh), [len(order)]]))
    most = np.maximum.reduceat(np.repeat(run, run), heads)
    again = np.concatenate([[False], (code[1:] == code[:-1]) & (bag[1:] == bag[:-1])])
    length = letters_of.astype(np.float64)
    last, lead = kind[stops - 1], kind[starts]
    per_word = lambda x: np.add.reduceat(x.astype(np.float64), heads) / n
    letters = np.maximum(counts[:, _LOWER] + counts[:, _UPPER], 1)
    columns = [
        np.zeros(len(heads)), np.log1p(n) / 4, counts[:, _UPPER] / letters, counts[:, _DIGIT] / size, counts[:, _STOP] / size, counts[:, _BANG] / size,
        counts[:, _BAR] / size, counts[:, _MARK] / size, counts[:, _QUOTE] / size, counts[:, _OTHER] / size, counts[:, _WIDE] / size,
        distinct / n, most / n, per_word(again), per_word(length) / 10, np.minimum(np.maximum.reduceat(length, heads) / 40, 3),
        per_word(last == _STOP), per_word(lead == _UPPER), per_word((last == _BANG) | (last == _MARK)), per_word((lead == _BAR) | (lead == _MARK)),
    ]
    out[full] = np.stack(columns, 1)
    return out, first


# -- the model -------------------------------------------------------------------


class AttentionModel:
    """Gated attention over encoded passages; the weights are plain arrays."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.w = {
            "W": rng.normal(0, 0.4, (n, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.4, (HIDDEN, GATE)), "U": rng.normal(0, 0.4, (HIDDEN, GATE)),
            "v": rng.normal(0, 0.4, GATE), "c": rng.normal(0, 0.4, HIDDEN), "c0": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        bag = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(x)]])))
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["v"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return bag, h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, first)[-1]

    def _gradient(self, x, first, y, weight):
        w = self.w
        bag, h, t, s, a, z, p = self._forward(x, first)
        d = (p - y) * weight / weight.sum()
        dz = d[:, None] * w["c"]
        along = (dz[bag] * h).sum(1)
        de = a * (along - np.add.reduceat(a * along, first)[bag])
        dg = de[:, None] * w["v"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "v": (t * s).T @ de, "c": z.T @ d, "c0": np.array([d.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 128, seed: int = 7) -> AttentionModel:
        """Adam on the weighted log loss, over shuffled batches of whole documents."""
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        size = np.diff(np.concatenate([first, [len(x)]]))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, epochs * -(-len(first) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(first))
            for chosen in np.array_split(order, -(-len(order) // batch)):
                n = size[chosen]
                heads = np.cumsum(n) - n
                rows = np.repeat(first[chosen] - heads, n) + np.arange(n.sum())
                step += 1
                rate = 0.01 * (1 - 0.9 * step / total)
                for k, g in self._gradient(x[rows], heads, y[chosen], weight[chosen]).items():
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


# -- on Spark --------------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, _ = passages([text.encode()])
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["label", "x"])


def held_out(doc_id):
    """The fifth of the documents that no fit may see, by a hash of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> AttentionModel:
    """Fits on a bounded, hash-chosen sample of labelled documents that are not held out.

    Null ids, texts and labels are passed over; a repeated label counts by its
    mean. Rows are weighted back to the shares of the classes among all labels,
    so that a score is a probability. Without both classes the model scores all
    documents alike.
    """
    model = AttentionModel(N_FEATURES)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(shares) != {0, 1}:
        model.w["c"][:] = 0
        model.w["c0"][:] = 4 if shares.get(1) else -4 if shares else 0
        return model
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [known.where(F.col("label") == k).orderBy(*order).limit(SAMPLE_ROWS) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_doc"), "label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = texts.join(sample, "_doc").select("label", "text").mapInArrow(_describe, "label int, x binary").collect()
    rows = sorted((r["label"], bytes(r["x"])) for r in rows)
    y = np.array([label for label, _ in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return model
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, N_FEATURES) for _, x in rows]
    first = np.cumsum([0, *(len(b) for b in bags[:-1])])
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    return model.fit(np.concatenate(bags), first, y, weight / weight.mean())


def _score(model: AttentionModel):
    def flush(ids: list, out: list, texts: list) -> pa.RecordBatch:
        p = model.scores(*passages(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(doc_id)
                out.append(held)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1]) + 64
                if size >= GROUP_BYTES:
                    yield flush(ids, out, texts)
                    ids, out, texts, size = [], [], [], 0
        if ids:
            yield flush(ids, out, texts)
        give_back()

    return run


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from its whole text.

    A null or empty text is a bag of one empty passage and gets a score like
    any other; a null id stays null and is not held out; repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), RESULT)


def _keep(model: AttentionModel, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 64
            group = np.cumsum(sizes) // GROUP_BYTES  # groups of bounded bytes
            for start, end in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows])):
                part = batch.slice(start, end - start)
                if part.num_rows:
                    texts = [(text.as_py() or "").encode() for text in part.column(column)]
                    yield part.filter(pa.array(model.scores(*passages(texts)) >= THRESHOLD))
        give_back()

    return run


def keep_quality(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns; a null text is scored as an empty one."""
    return docs.mapInArrow(_keep(model, docs.columns.index(text_col)), docs.schema)
