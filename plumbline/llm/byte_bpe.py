"""Byte-level BPE: encode whole texts by a rank file, and decode the ids again.

Three steps, without a shuffle. An Arrow step packs some megabytes of documents
into a few rows: the distinct words that the task has not sent yet as byte arrays,
a slice of them a row, and then each document as positions in the list of words.
Spark's higher-order functions fold the ranked merges over every word, looking
ranks up in a literal map, and concatenate the binary pieces of its ids for the way
back. A last Arrow step puts the words of each document together again.

All three run in one task and keep the order of rows, so that a word is folded once
a task: both ends keep the words so far, and drop them at the same row when they
grow past STORE_BYTES.

The rank map is keyed by the two ids that a merge joins. It is laid out as two
literal arrays: the rank of (a, b) stands at shift[a] + b, so that a lookup costs
two array reads at any vocabulary size. Pairs of single bytes are looked up for all
words of a slice at once, in a table of 257 by 257, before the fold. So are the first
EARLY merges of every word, by the same two arrays: a step of the fold costs
microseconds a word, and one over a whole slice a small part of that.

A step of the fold copies its word, so that its time grows with the square of the
word. Words of more than LONG_WORD bytes are therefore merged while packing, with
a heap of pairs; they join the folded words as ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count, groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import give_back

#: Bytes of text in one chunk; a single longer text makes a chunk of its own.
CHUNK_BYTES = 16_000_000
#: Bytes of words that a task keeps from one chunk to the next.
STORE_BYTES = 8_000_000
#: Words that are folded in one row.
SLICE_WORDS = 16_384
#: Bytes of a word up to which it is folded.
LONG_WORD = 512
#: Merges of a word that are made while packing; the fold makes the others.
EARLY = 3
RANK_BITS, PLACE_BITS = 17, 29
#: Stands before and after a word's bytes.
MARK = 256
#: Signs of the fast path: with a letter in front, the split pattern takes each by itself.
SIGNS = (".", ",", "!", "?", ";", ":")
#: The id of a mark, which merges with nothing; as a rank, no merge.
EDGE = (1 << RANK_BITS) - 1

#: White space as the split pattern understands it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: No match of a pattern that keeps white space in front of words crosses the start of a white-space run.
_STRETCH = regex.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ODD_SPACE = regex.compile(rf"[{_SPACE}] |\A[{_SPACE}]|[{_SPACE}]\Z")

CHUNK = "words array<array<bigint>>, known array<array<bigint>>, parts array<array<int>>, ids array<bigint>, rows array<array<int>>, done boolean"
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of every byte sequence of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain reference of the merge order: always the leftmost pair of lowest rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, EDGE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == EDGE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``fold_merges`` for a word of any length, with a heap of pairs by rank and place.

    ``after[i]`` is where the token that starts at ``i`` ends, 0 once it is part of an earlier one.
    """
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapify(pairs)

    def meet(i: int, end: int) -> None:
        rank = ranks.get(word[i:end])
        if rank is not None:
            heappush(pairs, (rank, i, end))

    while pairs:
        _, i, end = heappop(pairs)
        middle = after[i]
        if not 0 < middle < n or after[middle] != end:
            continue  # one of the two is part of another token by now
        after[i], after[middle] = end, 0
        if end < n:
            before[end] = i
            meet(i, after[end])
        if before[i] >= 0:
            meet(before[i], end)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


def first_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The id of every byte, and the rank of merging every two of them; MARK merges with nothing."""
    ids = np.array([ranks[bytes([b])] for b in range(256)] + [EDGE], dtype=np.int64)
    merges = np.full((MARK + 1, MARK + 1), EDGE, dtype=np.int32)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            merges[piece[0], piece[1]] = rank
    return ids, merges


class RankMap:
    """A rank file as literal arrays ``shift``, ``slots`` and ``pieces``, and the ``tables`` of first ranks and of these two for numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= EDGE or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank file needs all single bytes and ranks under 131,072")
        self.pieces = [b""] * (max(ranks.values()) + 1)
        pairs: dict[int, list[tuple[int, int]]] = {}
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.setdefault(a, []).append((b, rank))
        self.shift, self.slots = _placed(pairs, len(self.pieces))
        self.tables = (*first_ranks(ranks), np.array([s or 0 for s in self.shift] + [0] * (EDGE + 1 - len(self.shift)), dtype=np.int32), np.array([*self.slots, -1]))
        if any(len(p) > 1 and fold_merges(p, ranks) != [r] for p, r in ranks.items()):
            raise ValueError("an entry of the rank file is not reached by its own merges; the fold would miss it as a whole word")


def _placed(pairs: dict[int, list[tuple[int, int]]], size: int) -> tuple[list[int | None], list[int]]:
    """The sparse matrix of ranks in one array: row ``a`` is shifted until all its entries hit free slots.

    An entry holds its row beside its rank, so that a slot of another row is told apart; -1 is of no row.
    """
    rng = np.random.default_rng(1)
    room = 4 * sum(map(len, pairs.values())) + 1024
    used = np.zeros(room + size, dtype=bool)
    shift: list[int | None] = [None] * size
    slots = [-1] * len(used)
    for a in sorted(pairs, key=lambda x: (-len(pairs[x]), x)):
        columns = np.array([b for b, _ in pairs[a]])
        for tries in (64, 512, 4096, 32768):
            places = rng.integers(0, room, tries)
            free = np.flatnonzero(~used[places[:, None] + columns].any(axis=1))
            if len(free):
                break
        else:
            raise ValueError("no room for a row of the rank table")
        by = int(places[free[0]])
        used[by + columns] = True
        shift[a] = by
        for b, rank in pairs[a]:
            slots[by + b] = a << RANK_BITS | rank
    return shift, slots


@lru_cache(maxsize=2)
def rank_map(path: str) -> RankMap:
    return RankMap(read_ranks(path))


# -- packing -----------------------------------------------------------------


def stretches(text: str) -> list[str | tuple[str]]:
    """``text`` cut before every run of white space: the pattern splits each piece by itself.

    A plain string stands for itself with a space in front, a tuple for what it holds.
    """
    if _ODD_SPACE.search(text):
        return [(x,) for x in _STRETCH.findall(text)]
    pieces = text.split(" ")
    pieces[0] = (pieces[0],)
    return pieces


def _pack(pattern: str, path: str, tables: tuple[np.ndarray, ...] | None = None):
    find = regex.compile(pattern).findall
    ranks: dict[bytes, int] = {}  # read by the first task that meets a long word
    tables = tables or rank_map(path).tables

    def row(words=None, known=None, parts=None, ids=None, rows=None, done=None) -> pa.RecordBatch:
        kinds = [pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
        columns = [pa.nulls(1, k) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x, k in zip((words, known, parts, ids, rows), kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([done], pa.bool_())], ["words", "known", "parts", "ids", "rows", "done"])

    def encoded(words: list[bytes]) -> pa.ListArray:
        ranks.update({} if ranks else read_ranks(path))
        return pa.array([merge_long(w, ranks) for w in words], pa.list_(pa.int64()))

    def flush(ids: list, rows: list, seen: dict, words: dict[str, int], store: list[int]) -> Iterator[pa.RecordBatch]:
        """Sends the words that are new to ``words``, which hold ``store[0]`` bytes, then the documents."""
        parts, ends, sent = [], [0], len(words)
        for piece in seen:
            if type(piece) is tuple:
                parts += map(words.__getitem__, find(piece[0]))
            elif piece.isalpha():  # most pieces are a word, or a word and a sign: no need to search
                parts.append(words[" " + piece])
            elif piece[-1:] in SIGNS and piece[:-1].isalpha():
                parts += (words[" " + piece[:-1]], words[piece[-1]])
            else:
                parts += map(words.__getitem__, find(" " + piece))
            ends.append(len(parts))
        seen.clear()
        raw = [w.encode() for w in islice(words, sent, None)]
        for long, run in groupby(raw, lambda w: len(w) > LONG_WORD):
            run = list(run)
            for part in (run[start : start + SLICE_WORDS] for start in range(0, len(run), SLICE_WORDS)):
                yield row(known=encoded(part)) if long else row(words=_started(part, *tables))
        codes, store[0] = _lists(np.concatenate(rows), np.cumsum([0, *map(len, rows)])), store[0] + sum(map(len, raw))
        done = store[0] > STORE_BYTES
        if done:
            words.clear()
            words.default_factory, store[0] = count().__next__, 0
        yield row(parts=_lists(np.array(parts, dtype=np.int32), np.array(ends)), ids=pa.array(ids, pa.int64()), rows=codes, done=done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, seen, size = [], [], defaultdict(count().__next__), 0
        words, store = defaultdict(count().__next__), [0]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                pieces = stretches(text)
                size += len(text)
                ids.append(doc_id)
                rows.append(np.fromiter(map(seen.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
                if size >= CHUNK_BYTES:
                    yield from flush(ids, rows, seen, words, store)
                    ids, rows, seen, size = [], [], defaultdict(count().__next__), 0
        if ids:
            yield from flush(ids, rows, seen, words, store)
        del ids, rows, seen, words
        give_back()

    return run


def _started(words: list[bytes], byte_ids: np.ndarray, merges: np.ndarray, shift: np.ndarray, slots: np.ndarray) -> pa.ListArray:
    """The words as tokens after EARLY merges, with a mark before and after each; every token holds the rank of merging it with the next, its place and its id."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 2
    ends = np.concatenate([[0], np.cumsum(sizes)])
    values = np.full(ends[-1] + 1, MARK, dtype=np.int16)
    inside = np.ones(ends[-1], dtype=bool)
    inside[ends[:-1]] = inside[ends[1:] - 1] = False
    values[:-1][inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
    places = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    ranks = merges[values[:-1], values[1:]].astype(np.int64)
    state = ranks << (RANK_BITS + PLACE_BITS) | places << RANK_BITS | byte_ids[values[:-1]]
    for _ in range(EARLY):
        state, ends = _stepped(state, ends, shift, slots)
    return _lists(state, ends)


def _stepped(state: np.ndarray, ends: np.ndarray, shift: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of the fold for all words: each makes its leftmost merge of lowest rank, if it has one."""
    low = RANK_BITS + PLACE_BITS

    def ranked(base: np.ndarray, after: np.ndarray) -> np.ndarray:
        a = base & EDGE
        entry = slots.take(shift[a] + after, mode="clip")  # the last slot is of no row
        return np.where(entry >> RANK_BITS == a, entry & EDGE, EDGE) << low | base

    sizes = np.diff(ends)
    least = np.minimum.reduceat(state, ends[:-1])
    merges = least < EDGE << low
    at = np.flatnonzero(state == np.repeat(least, sizes))[merges]  # places tell the tokens of a word apart
    new, before, after = least[merges] >> low, state[at - 1], state[at + 2] & EDGE
    state[at] = ranked(state[at] & (((1 << PLACE_BITS) - 1) << RANK_BITS) | new, after)
    state[at - 1] = ranked(before & ((1 << low) - 1), new)
    kept = np.ones(len(state), dtype=bool)
    kept[at + 1] = False
    return state[kept], np.concatenate([[0], np.cumsum(sizes - merges)])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


# -- the fold ------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def encode_words(words: Column, ranks: RankMap) -> Column:
    """Token ids of every byte array in ``words``, as ``_started`` makes them.

    The state of the fold is one bigint per token: the rank of merging it with
    the next token, its place in the word, and its id. The smallest of them is
    the leftmost merge of lowest rank.
    """
    tables = [_literal(v, "array<bigint>") for v in (ranks.shift, ranks.slots)]
    # named once, so that the plan, and all that prints it, holds each table once
    return _let(tables[0], lambda shift: _let(tables[1], lambda slots: _folded(words, shift, slots)))


def _folded(words: Column, shift: Column, slots: Column) -> Column:
    id_mask, low = F.lit(EDGE), RANK_BITS + PLACE_BITS
    none = F.lit(EDGE << low)

    def ranked(base: Column, after: Column) -> Column:
        """``base`` with the rank of merging its id with ``after`` in front; a slot of another row is far off and so no merge."""
        a = base.bitwiseAND(id_mask)
        entry = F.get(slots, (F.get(shift, a.cast("int")) + after).cast("int"))
        rank = F.least(id_mask, (entry - F.shiftleft(a, RANK_BITS)).bitwiseAND(F.lit(2**63 - 1)))
        return F.shiftleft(rank, low).bitwiseOR(base)

    def merged(state: Column, first: Column, at: Column) -> Column:
        """Joins the tokens at ``at`` and ``at + 1``; the token before and the new one meet new neighbours."""
        new = F.shiftright(first, low)
        before, after = F.get(state, at - 2), F.get(state, at + 1)
        bases = F.array(before.bitwiseAND(F.lit((1 << low) - 1)), first.bitwiseAND(F.lit(((1 << PLACE_BITS) - 1) << RANK_BITS)).bitwiseOR(new))
        follow = F.array(new, after.bitwiseAND(id_mask))
        return F.flatten(F.array(F.slice(state, F.lit(1), at - 2), F.zip_with(bases, follow, ranked), F.slice(state, at + 2, F.size(state))))

    def step(state: Column, _: Column) -> Column:
        def by(first: Column) -> Column:
            return F.when(first >= none, state).otherwise(_let(F.array_position(state, first).cast("int"), lambda at: merged(state, first, at)))

        return _let(F.array_min(state), by)

    def encode(word: Column) -> Column:
        inner = lambda state: F.transform(F.slice(state, F.lit(2), F.size(state) - 2), lambda t: t.bitwiseAND(id_mask))
        return F.aggregate(F.slice(word, F.lit(4), F.size(word)), word, step, inner)

    return F.transform(words, encode)


def decode_words(encoded: Column, ranks: RankMap) -> Column:
    """The bytes of all id arrays in ``encoded``, as the binary pieces of their ids one after the other."""
    pieces = _literal([p.decode("latin-1") for p in ranks.pieces], "array<string>")  # a character for each byte
    return F.encode(F.array_join(F.transform(F.flatten(encoded), lambda i: F.get(pieces, i.cast("int"))), ""), "ISO-8859-1")


# -- back to documents -----------------------------------------------------------


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``chosen`` of a list array, one after the other, and the length of each."""
    starts, lengths = starts[chosen], lengths[chosen]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(len(shift))], lengths


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the lists in the one list that a row holds."""
    inner = column.flatten()
    return inner.flatten().to_numpy(zero_copy_only=False), inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _assemble(piece_bytes: np.ndarray):
    """Back to documents; ``piece_bytes`` tells how many bytes each id stands for, and so where a word ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _assembled(batches, piece_bytes)
        give_back()

    return run


def _assembled(batches: Iterator[pa.RecordBatch], piece_bytes: np.ndarray) -> Iterator[pa.RecordBatch]:
    tokens, sizes, raw = [], [], []  # of the words that came in so far
    for batch in batches:
        for at in range(batch.num_rows):
            parts, ids, rows, done, encoded, decoded = (batch.column(i).slice(at, 1) for i in range(6))
            if ids.null_count:
                values, lengths = _values(encoded)
                tokens.append(values.astype(np.uint32))
                sizes.append(lengths)
                blob, cuts = decoded[0].as_py(), np.concatenate([[0], np.cumsum(piece_bytes[values])])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
                raw += [blob[a:b] for a, b in zip(cuts, cuts[1:])]
                continue
            tokens, sizes = [np.concatenate(tokens or [np.zeros(0, dtype=np.uint32)])], [np.concatenate(sizes or [np.zeros(0, dtype=np.int64)])]
            yield _documents(parts, ids, rows, tokens[0], sizes[0], raw)
            if done[0].as_py():
                tokens, sizes, raw = [], [], []


def _documents(parts: pa.Array, ids: pa.Array, rows: pa.Array, tokens: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
    """Token ids and bytes of every distinct piece, then of every document."""
    of_piece, n_words = _values(parts)
    piece_tokens, per_word = _gathered(tokens, _starts(sizes), sizes, of_piece)
    cuts = np.concatenate([[0], np.cumsum(n_words)])
    piece_sizes = np.diff(np.concatenate([[0], np.cumsum(per_word)])[cuts])
    piece_starts = _starts(piece_sizes)
    words, cuts = of_piece.tolist(), cuts.tolist()
    texts = [raw[words[a]] if b - a == 1 else b"".join([raw[w] for w in words[a:b]]) for a, b in zip(cuts, cuts[1:])]
    pieces, n_pieces = _values(rows)
    row_ends = np.concatenate([[0], np.cumsum(n_pieces)])
    out: list[list] = [[], [], []]
    for a, b in zip(row_ends, row_ends[1:]):
        chosen = pieces[a:b]
        found, _ = _gathered(piece_tokens, piece_starts, piece_sizes, chosen)
        out[0].append(len(found))
        out[1].append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
        out[2].append(hashlib.sha256(b"".join(map(texts.__getitem__, chosen.tolist()))).hexdigest())
    return pa.RecordBatch.from_arrays(
        [ids.flatten(), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    )


def byte_bpe_roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; returns the digests of both.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids as little-endian
    unsigned 32-bit integers, and the decoded bytes. A null text counts as
    empty (no tokens); a null id stays null; a repeated row gives a repeated
    result; an empty table gives no rows; other columns are ignored. ``path``
    is a ``.tiktoken`` rank file, ``pattern`` a split pattern that keeps white
    space in front of words. Special tokens are ordinary text.
    """
    ranks = rank_map(path)
    packed = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pack(pattern, path, ranks.tables), CHUNK)
    encoded = packed.select("parts", "ids", "rows", "done", F.coalesce("known", encode_words(F.col("words"), ranks)).alias("encoded"))
    decoded = encoded.select("parts", "ids", "rows", "done", "encoded", decode_words(F.col("encoded"), ranks).alias("decoded"))
    return decoded.mapInArrow(_assemble(np.array([len(p) for p in ranks.pieces], dtype=np.int64)), RESULT)
