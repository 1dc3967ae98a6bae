"""Near-duplicates by SimHash, found through an inverted index of fingerprint bytes.

Two fingerprints that differ in at most ``d`` bits differ in at most ``d`` of
their eight bytes, so they share at least ``8 - d`` bytes at the same positions.
The index lists fingerprints by the bytes at three positions at a time; the
triples are chosen so that every pair with five shared bytes meets in a list.
In a list the shared positional bytes of each pair are tallied, pairs below
``8 - d`` are dropped, and the rest is verified bit by bit. Pairs never leave
the task: a list yields one link for each member that is linked at all.

A list that is too long for this (many near copies) is dealt again by two more
bytes. Such a list has at most 2**24 members, and its links are found by
flipping bits, in time proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.components import components
from plumbline.llm.scratch import written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Members of a list whose pairs are tallied directly.
LIST_LIMIT = 1024
#: Members of a five-byte list from which flipping bits is cheaper than tallying.
FLIP_FROM = 4096
SLICE_BYTES = 1_000_000

#: Any five of eight positions hold three on one side, hence one of these.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FIVES = list(combinations(range(8), 5))

_SPACE = re.compile(rb"[\x20\t-\r]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _slices(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > SLICE_BYTES and (cut := _SPACE.search(raw, start + SLICE_BYTES)):
        yield raw[start : cut.start()]
        start = cut.start()
    yield raw[start:]


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without words."""
    votes, total, before = np.zeros((8, 8), dtype=np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    raw = text.encode().lower()  # bytes: A to Z only
    for part in _slices(raw):
        found = before + part.split()
        if len(found) >= words:
            hashes = np.array([hashed(b" ".join(s), SEED) for s in zip(*(found[i:] for i in range(words)))], dtype=">u8")
            columns = hashes.view(np.uint8).reshape(-1, 8)
            for i in range(8):
                votes[i] += np.bincount(columns[:, i], minlength=256) @ _BITS
            total += len(hashes)
        before = found[len(found) - words + 1 :] if len(found) >= words else found
    if not total:
        return hashed(b" ".join(before), SEED) if before else 0
    return int.from_bytes(np.packbits(2 * votes > total, axis=1).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py() or "", words) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


# -- links inside one list ----------------------------------------------------------


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member reachable from each of ``n``, given arrays of linked pairs."""
    root = np.arange(n)
    links = [np.stack(p) for p in pairs]
    a, b = np.concatenate(links, axis=1) if links else (np.zeros(0, int), np.zeros(0, int))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _tallied(fps: np.ndarray, bits: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs: shared positional bytes tallied, count filter, bits verified."""
    columns = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
    for start in range(0, len(fps), block):
        mine, rest = columns[start : start + block], columns[start:]
        shared = np.zeros((len(mine), len(rest)), dtype=np.uint8)
        for i in range(8):
            shared += mine[:, i, None] == rest[None, :, i]
        a, b = np.nonzero(shared >= 8 - bits)
        a, b = a[a < b] + start, b[a < b] + start
        near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        yield a[near], b[near]


def _flips(bits: int, positions: list[int]) -> Iterator[int]:
    for n in range(1, bits + 1):
        for chosen in combinations(positions, n):
            yield sum(1 << p for p in chosen)


def _flipped(fps: np.ndarray, free: list[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of sorted fingerprints that differ in the bytes ``free`` only."""
    places = [8 * (7 - byte) + bit for byte in free for bit in range(8)]
    for mask in _flips(bits, places):
        other = fps ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        a = np.flatnonzero((fps[at] == other) & (at > np.arange(len(fps))))
        if len(a):
            yield a, at[a]


def links_in_list(fps: np.ndarray, bits: int, shared: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A link (member, root) for every member that is not its own root; ``fps`` are distinct."""
    fps = np.sort(fps)
    if len(shared) == 5 and len(fps) >= FLIP_FROM:
        root = _roots(len(fps), _flipped(fps, [i for i in range(8) if i not in shared], bits))
    else:
        root = _roots(len(fps), _tallied(fps, bits))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _links(bits: int, subsets: list[tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the list that is still open: slot, key, fp

        def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                a, b = links_in_list(rows[:, 2].astype(np.int64).view(np.uint64), bits, subsets[int(rows[0, 0])])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            for part in np.split(rows, cuts):
                if held and len(part) and (held[-1][-1, :2] != part[0, :2]).any():
                    yield from close(np.concatenate(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield from close(np.concatenate(held))

    return run


def _listed(slots: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """``slot, key, fp`` of ``slot, fp``: the key holds the bytes at the slot's positions."""
    masks = [sum(0xFF << 8 * (7 - i) for i in s) for s in subsets]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    return slots.select("slot", F.col("fp").bitwiseAND(F.get(signed, F.col("slot"))).alias("key"), "fp")


def _linked_lists(lists: DataFrame, bits: int, subsets: list[tuple[int, ...]]) -> DataFrame:
    dealt = lists.select("slot", "key", "fp").repartition("slot", "key").sortWithinPartitions("slot", "key")
    return dealt.mapInArrow(_links(bits, subsets), "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints ``fp`` within ``bits`` of each other."""
    if not 1 <= bits <= 3:
        raise ValueError("three positional bytes at a time find up to 3 differing bits")
    every = F.explode(F.array(*[F.lit(i) for i in range(len(TRIPLES))])).alias("slot")
    lists = _listed(fps.select("fp", every), TRIPLES)
    sizes = lists.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = written(lists.join(sizes, ["slot", "key"]), "lists")
    # a long list is dealt again by every five positions that hold its three
    holders = F.array(*[F.array(*[F.lit(j) for j, five in enumerate(FIVES) if set(t) <= set(five)]) for t in TRIPLES])
    long = lists.where(F.col("n") > LIST_LIMIT).select("fp", F.explode(F.get(holders, F.col("slot"))).alias("slot")).distinct()
    short = lists.where(F.col("n") <= LIST_LIMIT)
    return _linked_lists(short, bits, TRIPLES).unionByName(_linked_lists(_listed(long, FIVES), bits, FIVES))


# -- documents -------------------------------------------------------------------------


def with_fingerprint(docs: DataFrame, name: str, words: int = SHINGLE_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` with each text's fingerprint in a column ``name``."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py() or "", words) for text in batch.column(column)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, LongType())]))


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, root, component_id`` for every row; ``root`` tells components apart that have the same smallest id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint"), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(fingerprint_links(classes.select("fp"), bits))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = written(named.join(names, "root").select("fp", "root", "component_id"), "names")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows are linked when their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest id that links reach. A null or empty text
    has fingerprint zero and is linked like any other. A null id stays null and
    is never a component's name (null where a component has no other id);
    repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    groups = simhash_groups(docs, words, bits, id_col, text_col)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
