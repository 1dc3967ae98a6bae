"""The trie of conversation prefixes, by van Emde Boas recursion over its depth.

A sequence is cut at half depth; the cut prefix gets a name, which is the context
of everything below it; the trie above and the forest below the cut are built
alike, each from its own half. Names are digests of (context, content), so both
halves, and all tries of a level, are named at once and equal prefixes meet by
name. Totals run the other way: when two halves of a level are joined, what the
root of a lower trie holds is grafted onto the nodes above it up to the root of
the upper trie. A level of blocks takes one round, so rounds are the logarithm of
the depth, and a node sends to as many nodes as its block is deep.

Sequences lie in chunks of a fixed number of depths. Within a chunk the recursion
runs in a task; above it, blocks of chunks are named and grafted by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import written

#: Depths of a chunk, a power of two.
CHUNK = 256
#: Bytes of a name.
NAME = 16
#: Ids that travel as one text to the digest of a node's ends.
TEXT_IDS = 10_000

ROOT = b"root".ljust(NAME, b"\0")
PATHS = "conv bigint, chunk bigint, total bigint, names binary, words array<bigint>"
BLOCKS = "conv bigint, at bigint, block binary"


def _digest(kind: bytes, a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(kind + a + b).digest()[:NAME]


def block_name(contents: list[bytes]) -> bytes:
    """Name of a whole block, a power of two long, from the names of its halves."""
    while len(contents) > 1:
        contents = [_digest(b"b", a, b) for a, b in zip(contents[::2], contents[1::2])]
    return contents[0]


def name_prefixes(context: bytes, contents: list[bytes]) -> list[bytes]:
    """Names of all prefixes of a chunk, cut at half depth again and again."""
    if len(contents) == 1:
        return [_digest(b"n", context, contents[0])]
    half = 1 << (len(contents) - 1).bit_length() - 1
    cut = _digest(b"c", context, block_name(contents[:half]))
    return name_prefixes(context, contents[:half]) + name_prefixes(cut, contents[half:])


def _cells(packed: bytes) -> list[bytes]:
    return [packed[i : i + NAME] for i in range(0, len(packed), NAME)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [block_name(_cells(b"".join(x))) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary())], ["conv", "at", "block"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for contents, cuts in zip(batch.column("contents").to_pylist(), batch.column("cuts").to_pylist()):
            context = ROOT
            for block in cuts or []:
                context = _digest(b"c", context, block)
            out.append(b"".join(name_prefixes(context, contents)))
        columns = [batch.column("conv"), batch.column("chunk"), batch.column("total"), pa.array(out, pa.binary()), batch.column("words")]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "chunk", "total", "names", "words"])


# -- sequences --------------------------------------------------------------------------


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _placed(turns: DataFrame) -> DataFrame:
    """``conv, part, at, name, words`` of all turns in order, a long conversation over many parts; ``at`` counts within the part."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("name"), F.col("salt")]
    # rows that are equal in all else are told apart by where they were read, so that no key is too large for a part
    rows = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("conv", "name", "words", F.monotonically_increasing_id().alias("number")), "turns")
    return rows.withColumn("part", F.shiftright("number", 33))


def _rebuilt(turns: DataFrame, head: Column, base: Column) -> DataFrame:
    """``conv, total, depth, content, words``: a root and then the turns of every rebuilt conversation.

    ``head`` turns come from the conversation ``base``; both are columns over ``conv``.
    """
    placed = _placed(turns)
    parts = placed.groupBy("conv", "part").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = (F.col("number") - F.col("start") + F.col("before")).alias("place")

    convs = parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", head.cast("bigint")).withColumn("base", base)
    # only the parts that begin a conversation can hold its first turns
    bases = convs.select(F.col("base").alias("conv")).distinct()
    firsts = placed.join(parts.join(bases, "conv", "left_semi"), ["conv", "part"]).select("conv", place, "name", "words")
    most = convs.agg(F.max("h")).first()[0] or 0
    firsts = firsts.where(F.col("place") < most).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "name", "words"))).alias("firsts"))
    convs = convs.join(firsts, "base", "left")
    taken = F.slice(F.coalesce("firsts", F.array().cast("array<struct<place: bigint, name: binary, words: bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = convs.select("conv", "h", taken.alias("taken"), F.size(taken).alias("m"), (F.size(taken) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = written(convs, "conversations")

    root = convs.select("conv", "total", F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("content"), F.lit(0).cast("bigint").alias("words"))
    first = convs.select("conv", "total", F.inline("taken")).select("conv", "total", (F.col("place") + 1).alias("depth"), F.col("name").alias("content"), "words")
    # a part of a conversation is no larger than a partition, so the join by (conv, part) has no hot key
    about = parts.join(convs.select("conv", "total", "h", "m"), "conv")
    own = placed.join(about, ["conv", "part"]).select("conv", "total", place, "name", "words", "h", "m").where(F.col("place") >= F.col("h"))
    own = own.select("conv", "total", (F.col("place") - F.col("h") + F.col("m") + 1).alias("depth"), F.col("name").alias("content"), "words")
    return root.unionByName(first).unionByName(own)


# -- names ------------------------------------------------------------------------------


def _contexts(chunks: DataFrame) -> DataFrame:
    """``conv, chunk, cuts``: the blocks that lie before a chunk, largest first, for the chunks after the first.

    Names of pairs of blocks come from the names of both, a level of blocks at a time.
    """
    whole = chunks.where(F.size("contents") == CHUNK).where(F.col("total") >= CHUNK)
    level = whole.select("conv", F.col("chunk").alias("at"), "contents").mapInArrow(_blocks, BLOCKS)
    levels, k = [], 0
    longest = (chunks.agg(F.max("chunk")).first()[0] or 0)
    while True:
        level = written(level, "blocks")
        levels.append(level.select("conv", F.lit(k).alias("level"), "at", "block"))
        k += 1
        if longest >> k == 0:
            break
        pairs = level.groupBy("conv", F.shiftright("at", 1).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "block"))).alias("p"))
        level = pairs.where(F.size("p") == 2).select("conv", "at", F.col("p.block").alias("p")).mapInArrow(_blocks, BLOCKS)
    blocks = reduce(DataFrame.unionByName, levels)
    bits = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.expr("chunk").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)
    asked = chunks.where("chunk > 0").select("conv", "chunk", F.explode(bits).alias("level")).withColumn("at", F.expr("shiftright(chunk, level) - 1"))
    found = asked.join(blocks, ["conv", "level", "at"])
    cuts = found.groupBy("conv", "chunk").agg(F.sort_array(F.collect_list(F.struct("level", "block")), asc=False).alias("cuts"))
    return cuts.select("conv", "chunk", F.col("cuts.block").alias("cuts"))


def _named(rebuilt: DataFrame) -> tuple[DataFrame, int]:
    """Chunks of all conversations with the names of their prefixes, and the deepest depth."""
    cells = F.sort_array(F.collect_list(F.struct("depth", "content", "words")))
    chunks = rebuilt.groupBy("conv", "total", F.floor(F.col("depth") / CHUNK).alias("chunk")).agg(cells.alias("c"))
    chunks = written(chunks.select("conv", "total", "chunk", F.col("c.content").alias("contents"), F.col("c.words").alias("words")), "chunks")
    deepest = chunks.agg(F.max("total")).first()[0] or 0
    if deepest >= CHUNK:
        chunks = chunks.join(_contexts(chunks), ["conv", "chunk"], "left")
    else:
        chunks = chunks.withColumn("cuts", F.lit(None).cast("array<binary>"))
    return written(chunks.select("conv", "chunk", "total", "contents", "words", "cuts").mapInArrow(_paths, PATHS), "paths"), deepest


def _last(names: Column) -> Column:
    return F.substring(names, -NAME, NAME)


def _nodes(paths: DataFrame, deepest: int) -> DataFrame:
    """``name, parent, up, depth, words, n_convs, conv_id`` of every node.

    ``up`` packs the names of the nodes that the node is grafted onto, top first:
    as many as the largest power of two in its depth, where they lie in its chunk.
    """
    cells = paths.select("conv", "chunk", "names", F.posexplode("words").alias("o", "words"))
    back = F.expr("o & -o")
    up = F.substring("names", NAME * (F.col("o") - back) + 1, NAME * back)
    nodes = cells.select(F.substring("names", NAME * F.col("o") + 1, F.lit(NAME)).alias("name"), up.alias("up"), (F.col("chunk") * CHUNK + F.col("o")).alias("depth"), "words", "conv")
    nodes = nodes.groupBy("name", "up", "depth", "words").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    nodes = nodes.withColumn("parent", F.when(F.length("up") > 0, _last(F.col("up"))))
    if deepest >= CHUNK:
        nodes = written(nodes, "nodes")
        ends = paths.select(F.col("conv").alias("conv_id"), ((F.col("chunk") + 1) * CHUNK).alias("depth"), _last(F.col("names")).alias("above"))
        nodes = nodes.join(ends.where(F.col("depth") <= deepest), ["conv_id", "depth"], "left")
        nodes = nodes.withColumn("parent", F.coalesce("parent", "above")).drop("above")
    return nodes


# -- totals -----------------------------------------------------------------------------


def _grafted(nodes: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """``name, leaves, saved``: what all grafts add to a node, a level of blocks after another."""
    grafts: list[DataFrame] = []
    own = nodes.select("name", "up", "depth", "conv_id", F.col("n_children").isNull().cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    for k in range(deepest.bit_length()):
        roots = own.where((F.expr("depth & -depth") == 1 << k) & (F.col("depth") > 0))
        held = roots.select("name", "up", "depth", "conv_id", "leaves", "saved")
        if grafts:
            keys = roots.select("name", "up", "depth", "conv_id")
            held = held.unionByName(reduce(DataFrame.unionByName, grafts).join(keys, "name").select(*held.columns))
        if 1 << k < CHUNK:
            each = F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda i: F.substring("up", NAME * i + 1, F.lit(NAME)))
            sent = held.select(F.explode(each).alias("name"), "leaves", "saved")
        else:
            held = held.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            low = F.floor(F.col("depth") / CHUNK)
            above = held.select("conv_id", "leaves", "saved", F.explode(F.sequence(low - ((1 << k) // CHUNK), low - 1)).alias("chunk"))
            met = above.join(paths.select(F.col("conv").alias("conv_id"), "chunk", "names"), ["conv_id", "chunk"])
            each = F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.substring("names", NAME * i + 1, F.lit(NAME)))
            sent = met.select(F.explode(each).alias("name"), "leaves", "saved")
        grafts.append(written(sent.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "grafts"))
    none = own.select("name", "leaves", "saved").limit(0)
    return reduce(DataFrame.unionByName, grafts, none).groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by name and id, as texts of a bounded number of ids."""
    out: list[tuple[bytes, int, str]] = []
    now, ids = None, []
    for batch in batches:
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != now or len(ids) == TEXT_IDS:
                if ids:
                    out.append((now, ids[0], ",".join(map(str, ids))))
                now, ids = name, []
            ids.append(conv)
        if out:
            yield _rows(out, [pa.binary(), pa.int64(), pa.string()], ["name", "first", "ids"])
            out = []
    if ids:
        yield _rows([(now, ids[0], ",".join(map(str, ids)))], [pa.binary(), pa.int64(), pa.string()], ["name", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each name's texts in order, text by text."""
    now, state = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _rows(out, [pa.binary(), pa.string()], ["name", "ends_sha256"])
    if now is not None:
        yield _rows([(now, state.hexdigest())], [pa.binary(), pa.string()], ["name", "ends_sha256"])


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def _ends(paths: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the nodes where conversations end; ids are dealt by (name, id), so that one name may take many tasks."""
    last = paths.where(F.col("chunk") * CHUNK + F.size("words") == F.col("total") + 1).select(_last(F.col("names")).alias("name"), "conv")
    texts = last.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(_texts, "name binary, first bigint, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, head: Column | None = None, base: Column | None = None,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    Nodes are the distinct sequences of first turns (role, text), from the root
    without turns. ``conv_id`` is the smallest conversation that starts with the
    node's; leaves and saved tokens are those of its subtree, itself included.
    With ``head`` and ``base`` (over a column ``conv``), the first ``head`` turns of
    a conversation are replaced by those of conversation ``base``: all it has, if
    fewer, and none if there is no such conversation.

    Turns are ordered by number, null first, then by the SHA-256 of role and text;
    a repeated row is a turn of its own. A null role or text is empty; rows with a
    null conversation take no part; a conversation may end up without turns and
    then belongs to the root alone; an empty table gives no rows; other columns are
    ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME))
    turns = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), name.alias("name"), count_words(text).cast("bigint").alias("words"))
    conv = F.col("conv")
    paths, deepest = _named(_rebuilt(turns, F.lit(0) if head is None else head, conv if base is None else base))
    nodes = _nodes(paths, deepest)
    kids = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, "name", "left"), "nodes")
    grafts = _grafted(nodes, paths, deepest)

    zero = F.lit(0).cast("bigint")
    whole = nodes.join(grafts, "name", "left").join(_ends(paths), "name", "left").select(
        "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        (F.coalesce("leaves", zero) + F.col("n_children").isNull().cast("bigint")).alias("n_leaves"),
        (F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = whole.join(parents.hint("merge"), "parent", "left")  # shuffled by the parent, of which adaptive execution splits a hot one
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
