"""Repeated passages: seeds on winnowed anchors, extended both ways.

Winnowing picks from every window of words the anchor (a short word sequence)
of smallest hash, so that two equal windows always hold the same anchor at the
same place. Documents are joined on the anchors that more than one of them
holds. Around such a seed a match reaches both ways as far as windows still
carry it: first the whole stretch of windows around the seed is matched at
once, and where that fails, at the ends of a maximal repeat, window by window.

Everything is matched against the smallest document id of a key, a minimum that
combines before the shuffle, so that a passage in many documents costs a row
for each of them and never a pair of them. Keys of stretches and windows are
128-bit digests of their words; anchors need only 64 bits, as a false seed adds
work but no match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import written

MIN_WORDS = 50
ANCHOR_WORDS = 12
#: Powers of a base that a task keeps from one document to the next.
KEPT_POWERS = 1 << 18

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit SipHash of every word, the same in every task."""
    from pandas.util import hash_array

    found = np.empty(len(words), dtype=object)
    found[:] = words
    return hash_array(found, categorize=False)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to ``n``, or more, of ``base`` and of its inverse modulo 2**64; a task keeps those that most documents need."""
    kept = _powers_of.get(int(base))
    if kept is not None and len(kept[0]) > n:
        return kept
    size = 1 << max(12, n.bit_length())
    with np.errstate(over="ignore"):
        factors = (base, np.uint64(pow(int(base), -1, 1 << 64)))
        found = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, f)])) for f in factors)
    if size <= KEPT_POWERS:
        _powers_of[int(base)] = found
    return found


class _Rolling:
    """Hashes of any word ranges of one document, from running sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        n = len(hashes)
        up, self.down = _powers(base, n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return _mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Windows:
    """Anchors of a document's windows, and the stretches of windows that share one."""

    def __init__(self, words: list[bytes], size: int = MIN_WORDS, anchor: int = ANCHOR_WORDS):
        self.size, self.n = size, max(0, len(words) - size + 1)
        if not self.n:
            return
        self.hashes = _word_hashes(words)
        self.rolling = [_Rolling(self.hashes, _BASES[0])]
        starts = np.arange(len(words) - anchor + 1)
        grams = self.rolling[0].of(starts, starts + anchor)
        span = size - anchor + 1
        # the last smallest anchor of each window: the first one in the reversed view
        view = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
        at = np.empty(self.n, dtype=np.int64)
        for start in range(0, self.n, 1 << 16):
            at[start : start + (1 << 16)] = view[start : start + (1 << 16)].argmin(axis=1) + np.arange(start, min(self.n, start + (1 << 16)))
        at = (len(grams) - 1 - at)[::-1]
        self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # first window of each stretch
        self.stop = np.concatenate([self.first[1:], [self.n]])
        self.anchors = grams[at[self.first]]

    def _keys(self, starts: np.ndarray, ends: np.ndarray, parts: int) -> list[np.ndarray]:
        """The first ``parts`` of the two halves of each range's digest; the second base is summed up for documents that need it."""
        self.rolling += [_Rolling(self.hashes, base) for base in _BASES[len(self.rolling) : parts]]
        return [r.of(starts, ends) for r in self.rolling[:parts]]

    def stretch_keys(self, chosen: np.ndarray, parts: int = 2) -> list[np.ndarray]:
        return self._keys(self.first[chosen], self.stop[chosen] + self.size - 1, parts)

    def window_keys(self, starts: np.ndarray, parts: int = 2) -> list[np.ndarray]:
        return self._keys(starts, starts + self.size, parts)

    def starts_in(self, chosen: np.ndarray) -> np.ndarray:
        lengths = self.stop[chosen] - self.first[chosen]
        return np.repeat(self.first[chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _set(column: pa.Array, i: int) -> np.ndarray:
    value = column[i]
    return value.values.to_numpy(zero_copy_only=False).view(np.uint64) if value.is_valid and len(value) else np.zeros(0, dtype=np.uint64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


# -- steps ----------------------------------------------------------------------


def _anchors(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = Windows((text.as_py() or "").encode().split(), size, anchor)
                if w.n:
                    found.append(np.unique(w.anchors))
                    ids.append(np.full(len(found[-1]), doc_id, dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), _signed(np.concatenate(found))], ["doc_id", "h"])

    return run


def _seeded(size: int, anchor: int):
    """Documents without seeds are done; of the others come the keys of their seeded stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, digests, keys = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = text.as_py() or ""
                words = raw.encode().split()
                seeds = _set(batch.column(2), i)
                counts.append(len(words))
                digests.append(_digest(words))
                w = Windows(words, size, anchor) if len(seeds) else None
                chosen = np.flatnonzero(np.isin(w.anchors, seeds)) if w and w.n else np.zeros(0, dtype=np.int64)
                texts.append(raw if len(chosen) else None)
                pair = w.stretch_keys(chosen) if len(chosen) else [np.zeros(0, dtype=np.uint64)] * 2
                keys.append([{"k1": a, "k2": b} for a, b in zip(pair[0].view(np.int64).tolist(), pair[1].view(np.int64).tolist())])
            kind = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, kind)],
                ["doc_id", "text", "seeds", "n_words", "kept_sha256", "stretches"],
            )

    return run


def _open_windows(size: int, anchor: int):
    """Windows of seeded stretches that no smaller document repeats as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                w = Windows(batch.column(1)[i].as_py().encode().split(), size, anchor)
                chosen = np.flatnonzero(np.isin(w.anchors, _set(batch.column(2), i)))
                settled = np.isin(w.stretch_keys(chosen, 1)[0], _set(batch.column(3), i))
                starts = w.starts_in(chosen[~settled])
                if len(starts):
                    a, b = w.window_keys(starts)
                    a, at = np.unique(a, return_index=True)
                    for column, values in zip(out, (np.full(len(a), doc_id, dtype=np.int64), a, b[at])):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), _signed(np.concatenate(out[1])), _signed(np.concatenate(out[2]))], ["doc_id", "k1", "k2"])

    return run


def _kept(size: int, anchor: int):
    """Removes the words under matched stretches and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = text.as_py().encode().split()
                w = Windows(words, size, anchor)
                chosen = np.flatnonzero(np.isin(w.anchors, _set(batch.column(2), i)))
                settled = np.isin(w.stretch_keys(chosen, 1)[0], _set(batch.column(3), i))
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, w.first[chosen[settled]], 1)
                np.add.at(edge, w.stop[chosen[settled]] + size - 1, -1)
                starts = w.starts_in(chosen[~settled])
                starts = starts[np.isin(w.window_keys(starts, 1)[0], _set(batch.column(4), i))]
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                counts.append(len(words))
                removed.append(int(gone.sum()))
                digests.append(_digest([word for word, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return run


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _repeated(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The keys that more than one document holds, with the smallest of them.

    Written, so that the join that follows meets two plain shuffles and a hot
    key on the other side can be split.
    """
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return written(found.where("least < most").select(*keys, "least"), label)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row.

    A word goes when it lies in a window of ``min_words`` words whose sequence
    also starts in a document with a smaller id; windows are judged on the
    input. A null text has no words. A row without id neither loses words nor
    takes them from others; rows with the same id do not take from each other;
    an empty table gives no rows; other columns are ignored.
    """
    size, anchor = min_words, anchor_words
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = rows.where(F.col("doc_id").isNotNull())

    anchors = written(named.mapInArrow(_anchors(size, anchor), "doc_id bigint, h bigint"), "anchors")
    seeds = anchors.join(_repeated(anchors, ["h"], "seeds").select("h"), "h").groupBy("doc_id").agg(F.collect_set("h").alias("seeds"))

    schema = "doc_id bigint, text string, seeds array<bigint>, n_words bigint, kept_sha256 string, stretches array<struct<k1:bigint,k2:bigint>>"
    seeded = rows.join(written(seeds, "seeded"), "doc_id", "left").select("doc_id", "text", "seeds")
    seeded = written(seeded.mapInArrow(_seeded(size, anchor), schema), "stretches")
    done = seeded.where(F.col("text").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    matched = seeded.where(F.col("text").isNotNull())

    stretches = matched.select("doc_id", F.explode("stretches").alias("s")).select("doc_id", "s.k1", "s.k2")
    whole = stretches.join(_repeated(stretches, ["k1", "k2"], "whole"), ["k1", "k2"]).where("doc_id > least")
    whole = written(whole.groupBy("doc_id").agg(F.collect_set("k1").alias("whole")), "settled")

    open_docs = matched.join(whole, "doc_id", "left").select("doc_id", "text", "seeds", "whole")
    windows = written(open_docs.mapInArrow(_open_windows(size, anchor), "doc_id bigint, k1 bigint, k2 bigint"), "windows")
    single = windows.join(_repeated(windows, ["k1", "k2"], "single"), ["k1", "k2"]).where("doc_id > least")
    single = written(single.groupBy("doc_id").agg(F.collect_set("k1").alias("single")), "ends")

    last = open_docs.join(single, "doc_id", "left").select("doc_id", "text", "seeds", "whole", "single")
    return done.unionByName(last.mapInArrow(_kept(size, anchor), RESULT))
