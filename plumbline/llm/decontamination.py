"""Benchmark questions inside documents, also with other numbers, names and units.

Texts become templates: numbers (with the unit that follows) and names turn into
typed placeholders, everything else into its folded word. Windows of a benchmark
item's template are hash-joined with those of the documents. A capitalised word
that starts a sentence may be a name or not, so that windows over it are hashed
in both readings, as are those over an item's first word. Matches on one
diagonal of a document and an item are then checked for consistent slots: each
value of the item must stand for one and the same value in the document. A
window of hardly any plain words proves nothing by its template and is hashed
with its values; it also grows until it has enough of them and is then hashed as
a template, so that questions made of numbers are found with others in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import written

WINDOW = 8
#: Plain words that a window needs for its template to count.
PLAIN = 4
#: Words of the shortest item that is looked for.
SHORTEST = 4
#: Share of an item's windows that a document has to hold, or else this many windows in a row.
SHARE = 0.5
RUN = 13
#: Tokens that a window of hardly any plain words may grow to, as a multiple of its size.
GROWN = 2
#: Bits of the filter that spares most document windows the join; its size never depends on the data.
FILTER_BITS = 1 << 23
#: Bits of the filter of words that items have, which spares windows over any other word.
WORD_BITS = 1 << 22
#: Bytes of text whose words are looked up and whose windows are hashed at a time.
CHUNK = 1 << 22
KEPT_WORDS = 400_000
#: Readings of windows that are hashed at a time.
READINGS = 1 << 17

#: Words that stand for a number, and units (with the forms in which they follow one).
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
)
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter "
    "liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "% percent usd eur gbp dollar dollars euro euros cent cents kph mph km/h m/s hz khz mhz ghz kb mb gb tb v volt volts w kw watt watts j kj cal kcal "
    "k c f °c °f degree degrees point points meter meters metre metres kilometer kilometers kilometre kilometres kilogram kilograms gram grams".split()
)
#: Signs that count as words where they stand alone; a dash does not, as it is punctuation more often.
SIGNS = frozenset("+ * / = < > ^ × ÷".split())
_EDGES = re.compile(r"^[^\w$€£%°+-]+|[^\w%°]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?(?:\d[\d.,:/]*)(?P<unit>[^\W\d_/%°]*[%°]?[^\W\d_]*(?:/[^\W\d_]+)?)")
_ENDS = re.compile(r"[.!?:][^\w\s]*$")

_WORD, _NUM, _CAP, _UNIT, _EMPTY = range(5)


class _Tokens(dict):
    """word -> position in parallel arrays of kind, hash of the folded word, whether a sentence ends, and whether ``filter`` (none: any) lists it."""

    def __init__(self, filter: np.ndarray | None = None):
        super().__init__()
        self.new: list[tuple[int, int, bool]] = []
        self.filled = 0
        self.filter = filter
        self.kinds, self.hashes, self.ends, self.listed = np.zeros(1024, dtype=np.int8), np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=bool), np.ones(1024, dtype=bool)

    def __missing__(self, word: str) -> int:
        stem = word[:-1] if word[-1:] in ".,!?:" else word
        if stem.isalpha():  # most words: no edges to strip and no digits
            folded = stem.casefold()
            if folded in NUMBER_WORDS:
                kind = _NUM
            elif folded in UNITS:
                kind = _UNIT
            else:
                kind = _CAP if stem[0].isupper() and len(stem) > 1 and stem[1:].islower() else _WORD
            at = self[word] = len(self)
            self.new.append((kind, xxhash.xxh64_intdigest(folded, 5), word[-1] in ".!?:"))
            return at
        bare = word if word in SIGNS else _EDGES.sub("", word)
        folded = bare.casefold()
        number = _NUMBER.fullmatch(bare)
        if not folded:
            kind = _EMPTY
        elif number and (not number["unit"] or number["unit"].casefold() in UNITS) or folded in NUMBER_WORDS:
            kind = _NUM
        elif folded in UNITS:
            kind = _UNIT
        elif bare[:1].isupper() and len(bare) > 1 and bare[1:].islower():
            kind = _CAP
        else:
            kind = _WORD
        at = self[word] = len(self)
        self.new.append((kind, xxhash.xxh64_intdigest(folded, 5), bool(_ENDS.search(word))))
        return at

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > KEPT_WORDS:
            self.clear()
            self.__init__(self.filter)
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        self._fill()
        return self.kinds[at], self.hashes[at], self.ends[at], self.listed[at]

    def _fill(self) -> None:
        """Moves new words into the arrays, which double when they are full."""
        if not self.new:
            return
        end = self.filled + len(self.new)
        while end > len(self.kinds):
            self.kinds, self.hashes, self.ends, self.listed = (np.concatenate([x, np.ones_like(x)]) for x in (self.kinds, self.hashes, self.ends, self.listed))
        kinds, hashes, ends = zip(*self.new)
        self.kinds[self.filled : end] = kinds
        self.hashes[self.filled : end] = np.array(hashes, dtype=np.uint64)
        self.ends[self.filled : end] = ends
        if self.filter is not None:
            self.listed[self.filled : end] = self.filter[_slot(self.hashes[self.filled : end], WORD_BITS)]
        self.filled = end
        self.new.clear()


_SLOT = {_NUM: np.uint64(0x51ED270B7A1C9F35), _CAP: np.uint64(0x2545F4914F6CDD1D)}
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Template:
    """Tokens of texts, one text after the other, after canonicalisation; ``start`` and ``stop`` name the words of each, ``text`` its text.

    ``open`` tokens count as words and may be read as names: capitals that start
    a sentence and, of an item, the first word. ``merged`` makes them names that
    take in the names after them. Plain words that no item has, by the filter
    of ``known``, are not ``listed``; no window over one can be an item's.
    """

    def __init__(self, texts: pa.Array, known: _Tokens, item: bool = False, merged: bool = False):
        split = pc.utf8_split_whitespace(texts)
        encoded = split.values.dictionary_encode()  # a word is looked up once, however often it comes
        self.words, self.word = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        self.seen: dict[int, str] = {}
        kind, value, ends, listed = (column[self.word] for column in known.of(self.words))
        text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        kept = np.flatnonzero(kind != _EMPTY)
        kind, value, ends, listed, text = kind[kept], value[kept], ends[kept], listed[kept], text[kept]
        first = np.concatenate([[True], text[1:] != text[:-1]])[: len(kept)]
        after = first | _shifted(ends)
        may = (kind == _CAP) & after
        name = (kind == _CAP) & ~after
        unit = (kind == _UNIT) & _shifted(kind == _NUM) & ~first
        leads = name | may if merged else name
        joins = unit | (name & _shifted(leads))
        if merged:
            taken = may & np.concatenate([joins[1:], [False]])[: len(kept)]
            name, may = name | taken, may & ~taken
        kind[(kind == _CAP) & ~name] = _WORD
        kind[kind == _UNIT] = _WORD
        head = np.flatnonzero(~joins)
        with np.errstate(over="ignore"):
            chained = value * np.where(joins, np.uint64(0xD6E8FEB86659FD93), np.uint64(1))
            self.value = np.add.reduceat(chained, head) if len(head) else value[:0]
        self.start = kept[head]
        self.stop = kept[np.concatenate([head[1:], [len(kept)]]) - 1] + 1 if len(head) else self.start
        self.kind = kind[head]
        self.open = may[head]
        self.text = text[head]
        if item:
            self.open |= first[head] & (self.kind == _WORD)
        self.shape = np.where(self.kind == _NUM, _SLOT[_NUM], np.where(self.kind == _CAP, _SLOT[_CAP], self.value))
        listed = listed[head] | self.open | (self.kind != _WORD)
        self._plain, self._opens, self._lost = (np.concatenate([[0], np.cumsum(x)]) for x in (self.kind == _WORD, self.open, ~listed))

    def _whole(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those of the windows at ``at`` that end in their text and hold listed tokens only."""
        at = at[at + size <= len(self.kind)]
        return at[(self._lost[at + size] == self._lost[at]) & (self.text[at + size - 1] == self.text[at])]

    def windows(self, size: int, grow: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Position, reading, hash and length of every window of ``size`` listed tokens; of shapes where enough are plain words, else of values.

        Bit ``j`` of a reading says that the ``j``-th open token of the window is a
        name. Where ``grow``, windows hashed by values come again as the shortest
        longer ones of enough plain words, by shapes.
        """
        at = self._whole(np.arange(len(self.kind)), size)
        plain = self._plain[at + size] - self._plain[at]
        enough = min(PLAIN, size)
        h = _mixed([self.shape[at + j] for j in range(size)], size)
        h[plain < enough] = self._valued(at[plain < enough], size)
        yield at, np.zeros(len(at), dtype=np.int64), h, size
        if grow:
            yield from self._grown(at[plain < enough], size)
        more = (1 << (self._opens[at + size] - self._opens[at])) - 1  # readings besides the first
        at, plain, more = at[more > 0], plain[more > 0], more[more > 0]
        until = np.cumsum(more)
        first = 0
        while first < len(at):
            done = until[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(until, done + READINGS, "right")))
            times = more[first:last]
            each = np.repeat(np.arange(first, last), times)
            reading = np.arange(len(each)) - np.repeat(until[first:last] - done - times, times) + 1
            place = at[each][:, None] + np.arange(size)
            named = self._named(place, reading)
            h = _mixed(list(np.where(named, _SLOT[_CAP], self.shape[place]).T), size)
            few = plain[each] - named.sum(axis=1) < enough
            h[few] = self._valued(at[each[few]], size)
            yield at[each], reading, h, size
            first = last

    def _valued(self, at: np.ndarray, size: int) -> np.ndarray:
        return _mixed([self.value[at + j] for j in range(size)], size) ^ np.uint64(0xA5A5A5A5)

    def _named(self, place: np.ndarray, reading: np.ndarray) -> np.ndarray:
        """Which tokens of the windows, one a row, their readings take for names."""
        return self.open[place] & ((reading[:, None] >> (self._opens[place] - self._opens[place[:, :1]]) & 1) == 1)

    def _grown(self, at: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """The windows at ``at``, each as long as PLAIN plain words take."""
        length = np.searchsorted(self._plain[1:], self._plain[at] + PLAIN) + 1 - at  # beyond the text where it has too few
        for longer in range(size + 1, GROWN * size + 1):
            own = self._whole(at[length == longer], longer)
            if len(own):
                yield own, np.zeros(len(own), dtype=np.int64), _mixed([self.shape[own + j] for j in range(longer)], longer), longer

    def slots(self, at: np.ndarray, size: int, reading: np.ndarray) -> list[list[str]]:
        """The values of the placeholders in each window."""
        place = at[:, None] + np.arange(size)
        held = (self.kind[place] != _WORD) | self._named(place, reading)
        values = [self.seen.get(i) or self._said(i) for i in place[held].tolist()]
        until = np.cumsum(held.sum(axis=1)).tolist()
        return [values[i:j] for i, j in zip([0, *until], until)]

    def _said(self, i: int) -> str:
        said = self.seen[i] = " ".join(_EDGES.sub("", self.words[w]) for w in self.word[self.start[i] : self.stop[i]].tolist()).casefold()
        return said


def _shifted(marks: np.ndarray) -> np.ndarray:
    """What holds for the one before."""
    return np.concatenate([[False], marks[:-1]])[: len(marks)]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _mixed(tokens: list[np.ndarray], size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(tokens[0]), np.uint64(size))
        for column in tokens:
            h = (h ^ column) * _BASE
            h ^= h >> np.uint64(29)
    return h


def _bits(slots: DataFrame, bits: int) -> bytes:
    """The filter that has the ``slot`` of every row, at most ``bits`` values, set."""
    found = np.zeros(bits, dtype=bool)
    found[slots.distinct().toPandas()["slot"].to_numpy()] = True
    return np.packbits(found).tobytes()


def _set(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


def _asked(text: pa.Array, known: _Tokens) -> list[Template]:
    """The readings of one item that are looked for: as it is and, where that makes a difference, with names at the start of sentences taken in."""
    t, x = Template(text, known, True), Template(text, known, True, True)
    return [y for y in (t, x) if len(y.kind) >= SHORTEST and (y is t or len(y.kind) < len(t.kind))]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``slot``: where the tokens of items are in the filter of words."""
    known = _Tokens()
    for batch in batches:
        found = [x.value for i in range(batch.num_rows) for x in _asked(batch.column(1).slice(i, 1), known)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(np.concatenate(found), WORD_BITS)), pa.int32())], ["slot"])


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHUNK bytes of text, and of whole texts."""
    part = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(i, j - i) for i, j in zip(ends, ends[1:]) if j > i)


def _item_windows(size: int):
    """Rows ``id, n, size, at, h, slots``: windows of items, each of its own size, in all readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for batch in batches:
            rows = _Rows()
            for i, key in enumerate(batch.column(0).to_pylist()):
                asked = _asked(batch.column(1).slice(i, 1), known)
                for x in asked:
                    length = min(size, len(x.kind))
                    n = max(1, len(asked[0].kind) - size + 1)
                    for at, reading, h, wide in x.windows(length, length == size):
                        place = np.searchsorted(asked[0].start, x.start[at])  # in tokens of the item as it is
                        rows.add(np.full(len(at), key), np.full(len(at), n), length, place, h, x.slots(at, wide, reading))
            yield rows.batch()

    return run


def _document_windows(size: int, lengths: list[int], bits: bytes, words: bytes):
    """Rows ``id, n, size, at, h, slots``: windows of documents, of all sizes, those the filters let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, known = _set(bits), _Tokens(_set(words))
        for batch in batches:
            for chunk in _chunks(batch):
                rows = _Rows()
                keys = chunk.column(0).to_numpy()
                t = Template(chunk.column(1), known)
                n = np.bincount(t.text, minlength=len(keys))
                first = np.cumsum(n) - n
                for length in lengths:
                    for at, reading, h, wide in t.windows(length, length == size):
                        hit = np.flatnonzero(passes[_slot(h, FILTER_BITS)])
                        at, reading = at[hit], reading[hit]
                        text = t.text[at]
                        rows.add(keys[text], np.maximum(1, n[text] - length + 1), length, at - first[text], h[hit], t.slots(at, wide, reading))
                yield rows.batch()

    return run


class _Rows:
    """Windows, gathered for a batch."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.slots: list[list[str]] = []

    def add(self, key: np.ndarray, n: np.ndarray, size: int, at: np.ndarray, h: np.ndarray, slots: list[list[str]]) -> None:
        if len(at):
            self.parts.append((key, n, np.full(len(at), size), at, h.view(np.int64)))
            self.slots += slots

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = [np.concatenate(x) for x in zip(*self.parts)] or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(self.slots, pa.list_(pa.string()))], ["id", "n", "size", "at", "h", "slots"])


_ROWS = "id bigint, n int, size int, at int, h bigint, slots array<string>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, share, same_values`` for every document and item it holds.

    An item is held when at least ``share`` of its windows, or RUN in a row, match
    on diagonals whose slots are consistent; ``same_values`` says that no slot was changed.
    Null ids and texts take no part; items of fewer than four words are not
    looked for; shorter items than a window are one window; repeated rows count
    once; empty tables give no rows; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    words = _bits(items.mapInArrow(_listed, "slot int"), WORD_BITS)
    items = written(items.mapInArrow(_item_windows(window), _ROWS), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` values
    bits = _bits(items.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("slot")), FILTER_BITS)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    windows = written(rows.mapInArrow(_document_windows(window, sizes, bits, words), _ROWS), "windows")
    asked = items.select(F.col("id").alias("item_id"), F.col("n").alias("n_windows"), "size", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"))
    met = windows.select(F.col("id").alias("doc_id"), "size", "at", "h", "slots").join(asked, ["h", "size"]).where(F.size("slots") == F.size("item_slots"))
    pair = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs")
    key = ["doc_id", "item_id", "n_windows", "diagonal"]
    met = written(met.select("doc_id", "item_id", "n_windows", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", pair).distinct(), "met")

    # on a diagonal every value of the item stands for the value it meets most; readings of windows that say otherwise do not count
    pairs = met.select(*key, "item_at", "pairs", F.explode("pairs").alias("p")).select(*key, "item_at", "pairs", "p.a", "p.b")
    votes = pairs.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy(*key, "a").agg(F.max_by("b", F.struct("n", "b")).alias("best"))
    against = pairs.join(votes, [*key, "a"]).where(F.col("b") != F.col("best")).select(*key, "item_at", "pairs").distinct()
    changed = votes.where(F.col("a") != F.col("best")).select("doc_id", "item_id").distinct().withColumn("changed", F.lit(True))
    kept = met.join(against, [*key, "item_at", "pairs"], "left_anti").select(*key, "item_at").distinct()
    # windows in a row share their distance to their rank on the diagonal; no diagonal has more than an item's windows
    place = F.row_number().over(W.partitionBy(*key).orderBy("item_at"))
    kept = kept.withColumn("run", F.col("item_at") - place)
    kept = kept.withColumn("in_run", F.count(F.lit(1)).over(W.partitionBy(*key, "run")))
    kept = kept.groupBy("doc_id", "item_id", "n_windows").agg(F.countDistinct("item_at").cast("int").alias("n_matched"), F.max("in_run").alias("longest"))
    part = F.col("n_matched") / F.col("n_windows")
    held = kept.where((part >= share) | (F.col("longest") >= RUN)).join(changed, ["doc_id", "item_id"], "left")
    return held.select("doc_id", "item_id", "n_windows", "n_matched", F.round(part, 4).alias("share"), F.col("changed").isNull().alias("same_values"))
