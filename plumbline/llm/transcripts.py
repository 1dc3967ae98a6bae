"""Roles of raw transcripts by a hidden Markov model, rendered as canonical turns.

Every line of a transcript is observed as a speaker marker (a known word, some
name, or none), whether a blank line precedes it, its length and whether it
asks. Hidden states are a role that begins or goes on. Transitions, lengths and
questions are counted from labelled conversations; what markers say is given.
Viterbi finds the likeliest states. Names that are no known marker are bound to
the role that most of their lines got, and the transcript is decoded again. A name
that marks one line only may be a heading ("Note: ...") and stays in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import written

ROLES = ("system", "user", "assistant")
#: Marker words of each role, folded.
MARKERS = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "context": 0, "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "client": 1, "inst": 1, "prompter": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "agent": 2, "gpt": 2, "model": 2, "response": 2, "chatbot": 2,
}
LENGTHS = 14
#: Turns of one conversation that are put together; a longer one is rendered in parts.
PART_TURNS = 256
#: Words of the longest speaker's name.
NAME_WORDS = 5

_MARKER = re.compile(r"^(?:#{1,4}\s*|\*{1,2}|<\|?|\[)?\s*(?P<word>[^\W\d_][\w .'-]{0,63}?)\s*(?:\*{1,2})?\s*(?:\|?>|\]|:(?:\*{1,2})?)(?P<rest>.*)$", re.S)
_NONE, _NAME = 3, 4
#: Log chance of a marker (three roles, none, a name) where a role begins and where it goes on.
_BEGIN = np.log(np.array([[0.6 if r == m else 0.005 for m in range(3)] + [0.345, 0.045] for r in range(3)]))
_ON = np.log(np.array([[0.002] * 3 + [0.985, 0.009]] * 3))
_BLANK = np.log(np.array([[0.5, 0.5], [0.97, 0.03]]))  # begins, goes on: without and after a blank line

RESULT = "id bigint, part bigint, n_turns int, roles array<string>, contents array<string>, rendered string, line_roles array<string>"


class RoleModel:
    """Log probabilities over the states role + 3 * goes on."""

    def __init__(self, start: np.ndarray, follow: np.ndarray, more: np.ndarray, shape: np.ndarray):
        """``start[r]``, ``follow[r, r2]``, ``more[r]`` (share of lines after which a turn goes on), ``shape[r, length bin, asks]``; all counts."""
        share = lambda x, axis: (x + 0.5) / (x + 0.5).sum(axis=axis, keepdims=True)
        self.start = np.concatenate([np.log(share(start, 0)), np.full(3, -1e9)])
        self.later = np.concatenate([np.log(np.full(3, 1 / 3)), np.full(3, -1e9)])
        on = share(more, 1)[:, 0]
        step = np.full((6, 6), -1e9)
        for r in range(3):
            for state in (r, r + 3):
                step[state, r + 3] = np.log(on[r])
                step[state, :3] = np.log1p(-on[r]) + np.log(share(follow, 1)[r])
        self.step = step
        self.shape = np.log(share(shape, (1, 2)))

    def decode(self, markers: np.ndarray, blank: np.ndarray, length: np.ndarray, asks: np.ndarray, opens: bool) -> np.ndarray:
        emit = np.empty((len(markers), 6))
        emit[:, :3] = _BEGIN[:, markers].T + _BLANK[0, blank][:, None]
        emit[:, 3:] = _ON[:, markers].T + _BLANK[1, blank][:, None]
        emit += np.tile(self.shape[:, length, asks].T, 2)
        score, back = (self.start if opens else self.later) + emit[0], np.zeros((len(markers), 6), dtype=np.int8)
        for i in range(1, len(markers)):
            reach = score[:, None] + self.step
            back[i] = reach.argmax(axis=0)
            score = reach.max(axis=0) + emit[i]
        path = np.empty(len(markers), dtype=np.int64)
        path[-1] = score.argmax()
        for i in range(len(markers) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def _marked(line: str) -> tuple[int, str, str]:
    """Marker class of a line, the name in it, and the line without its marker."""
    found = _MARKER.match(line)
    if not found:
        return _NONE, "", line
    word = found["word"].strip().casefold()
    known = MARKERS.get(word)
    if known is None and (len(word.split()) > NAME_WORDS or not all(w[0].isupper() or not w[0].isalpha() for w in found["word"].split())):
        return _NONE, "", line
    return (_NAME if known is None else known), word, found["rest"].strip()


def length_bin(n: int) -> int:
    return min(LENGTHS - 1, n.bit_length())


def parse(transcript: str, model: RoleModel, opens: bool = True) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, content) of a transcript, and the role of each line that is not blank."""
    lines, blank, before = [], [], False
    for line in transcript.split("\n"):
        if line.strip():
            lines.append(line)
            blank.append(int(before))
        before = not line.strip()
    if not lines:
        return [], []
    marked = [_marked(line) for line in lines]
    markers = np.array([m for m, _, _ in marked])
    sizes = np.array([length_bin(len(rest)) for _, _, rest in marked])
    asks = np.array([int(rest.rstrip().endswith("?")) for _, _, rest in marked])
    path = model.decode(markers, np.array(blank), sizes, asks, opens)
    names: dict[str, list[int]] = {}
    for i, (m, name, _) in enumerate(marked):
        if m == _NAME:
            names.setdefault(name, []).append(i)
    if names:
        for own in names.values():
            if len(own) > 1 or len(names) > 1:
                markers[own] = np.bincount(path[own] % 3, minlength=3).argmax()
        path = model.decode(markers, np.array(blank), sizes, asks, opens)
    turns: list[tuple[str, list[str]]] = []
    for line, (m, name, rest), state in zip(lines, marked, path.tolist()):
        begins = state < 3 or not turns
        if begins:
            turns.append((ROLES[state % 3], []))
        speaks = m != _NONE and (m != _NAME or len(names[name]) > 1)
        own = rest if speaks and begins else line
        if own or not begins:
            turns[-1][1].append(own)
    return [(role, "\n".join(content)) for role, content in turns], [ROLES[s % 3] for s in path.tolist()]


def rendered(turns: list[tuple[str, str]]) -> str:
    """Canonical form: a role line, the content, and an end line for each turn."""
    return "\n".join(f"<|{role}|>\n{content}\n<|end|>" for role, content in turns)


def _parse(model: RoleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for part, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                turns, lines = parse(text.as_py() or "", model, not part)
                for column, value in zip(out, (len(turns), [r for r, _ in turns], [c for _, c in turns], rendered(turns), lines)):
                    column.append(value)
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), texts, texts, pa.string(), texts)))],
                ["id", "part", "n_turns", "roles", "contents", "rendered", "line_roles"],
            )

    return run


def fit_roles(turns: DataFrame) -> RoleModel:
    """Counts transitions and line features over all labelled turns (conv_id, turn, role, text).

    Rows whose role is none of the three, or without id or turn, are passed over.
    """
    code = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), code.alias("r"), F.col("text").cast("string").alias("text"))
    rows = rows.where((F.col("r") >= 0) & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    start, follow, more, shape = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 2)), np.zeros((3, LENGTHS, 2))
    for r in rows.where("turn = 0").groupBy("r").count().collect():
        start[r["r"]] = r["count"]
    after = rows.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("r2"))
    for r in rows.select("conv", "turn", "r").join(after, ["conv", "turn"]).groupBy("r", "r2").count().collect():
        follow[r["r"], r["r2"]] = r["count"]
    lines = rows.select("r", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines")).where(F.size("lines") > 0)
    for r in lines.groupBy("r").agg(F.sum(F.size("lines") - 1).alias("on"), F.count(F.lit(1)).alias("end")).collect():
        more[r["r"]] = (r["on"], r["end"])
    one = lines.select("r", F.explode("lines").alias("line"))
    size = F.least(F.lit(LENGTHS - 1), F.length(F.bin(F.length("line")))).alias("size")
    for r in one.groupBy("r", size, F.rtrim("line").endswith("?").cast("int").alias("asks")).count().collect():
        shape[r["r"], r["size"], r["asks"]] = r["count"]
    return RoleModel(start, follow, more, shape)


def parse_transcripts(transcripts: DataFrame, model: RoleModel, id_col: str = "conv_id", part_col: str = "part", text_col: str = "transcript") -> DataFrame:
    """``id, part, n_turns, roles, contents, rendered, line_roles`` for every transcript.

    A null or blank transcript has no turns; null ids stay null; repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored.
    """
    return transcripts.select(F.col(id_col).cast("long"), F.col(part_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_parse(model), RESULT)


#: How a transcript marks its speakers, by style: for system, user, assistant.
STYLES = (("System: ", "User: ", "Assistant: "), ("### System: ", "### Human: ", "### Assistant: "), ("", "Q: ", "A: "), ("Moderator: ", "Maria: ", "Jonas: "), ("\n", "\n", "\n"))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """``conv_id, part, transcript, stored`` from labelled turns: their text in order, marked in one of five styles.

    The style follows from the id. Repeated rows count once; rows without id
    are left out; a null turn comes first; a null text is empty; turns of one
    number are ordered by role and text. A conversation of more than PART_TURNS
    turns makes several parts of that many, counted and not by their numbers, so
    that no group grows without bound. ``stored`` holds the role of each line that
    is not blank.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col("conv_id").isNotNull()).distinct()
    # places without a task for each conversation: sorted ranges are numbered, and a range starts after the turns of those before
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32), F.md5("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    rows = written(rows, "turns").withColumn("span", F.shiftright("number", 33))
    spans = rows.groupBy("conv_id", "span").agg(F.min("number").alias("least"), F.count(F.lit(1)).alias("n"))
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(spans, ["conv_id", "span"]).withColumn("place", F.col("number") - F.col("least") + F.col("before"))
    part = F.floor(F.col("place") / PART_TURNS).alias("part")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    grouped = rows.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    mark = lambda t: F.coalesce(F.element_at(F.get(F.array(*[_map(s) for s in STYLES]), style), F.coalesce(t["role"], F.lit(""))), F.lit(""))
    marked = lambda t: F.concat(mark(t), t["text"])
    lines = lambda t: F.size(F.filter(F.split(marked(t), "\n"), lambda x: F.length(F.trim(x)) > 0))
    return grouped.select(
        "conv_id", "part", F.array_join(F.transform("turns", marked), "\n").alias("transcript"),
        F.flatten(F.transform("turns", lambda t: F.array_repeat(F.coalesce(t["role"], F.lit("")), lines(t)))).alias("stored"),
    )


def _map(style: tuple[str, ...]) -> Column:
    return F.create_map(*[F.lit(x) for pair in zip(ROLES, style) for x in pair])


def chat_format(turns: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, roles, rendered, n_lines, n_right`` for every conversation part.

    ``n_right`` counts the lines whose recovered role is the stored one.
    """
    model = fit_roles(turns)
    whole = written(as_transcripts(turns), "transcripts")
    found = parse_transcripts(whole, model)
    met = found.withColumnsRenamed({"id": "conv_id"}).join(whole.select("conv_id", "part", "stored"), ["conv_id", "part"])
    return met.select("conv_id", "part", "n_turns", F.array_join("roles", ",").alias("roles"), "rendered", F.size("stored").alias("n_lines"), _agree().alias("n_right"))


def _agree() -> Column:
    same = F.zip_with("stored", "line_roles", lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
