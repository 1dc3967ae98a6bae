"""Secrets in text: fixed patterns, and literals assigned to sensitive names.

The lexer reads source and configuration syntax (``name = "x"``, ``"name": "x"``,
``name := x``, ``NAME=x``, ``name => 'x'``, ``"a" + "b"``) into pairs of a name and
its literals, follows names that stand for constants, and scores each literal by
the words of the name it ends up in and by its own make-up.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fixed patterns; letters of the keywords in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a name's words; a name counts as its heaviest word or pair of words.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 3.0, "apikey": 3.0, "credential": 3.0,
    "credentials": 3.0, "auth": 2.0, "bearer": 2.0, "signature": 1.0, "salt": 1.0, "key": 1.0, "pin": 0.5,
}
PAIR_WEIGHTS = {("api", "key"): 3.0, ("access", "key"): 3.0, ("private", "key"): 3.0, ("secret", "key"): 3.0, ("encryption", "key"): 3.0, ("account", "key"): 3.0, ("pass", "word"): 3.0}
#: A literal is reported when the name's weight times its own score reaches this.
THRESHOLD = 1.5
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|changeme|example|placeholder|todo|test|your[-_ ]?\w*|<.*>|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|%\w*%)$")

# possessive, so that names and literals of any length are read in one go
_NAME = r"""["']?(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)["']?(?:\])?"""
_TERM = r"""(?:[rbfuRBFU]{0,2}"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|[rbfuRBFU]{0,2}'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|[A-Za-z0-9_$][A-Za-z0-9_.+/=$~!@%^&*\-]*+)"""
_PAIR = re.compile(rf"(?<![A-Za-z0-9_.\-]){_NAME}[ \t]*(?P<op>:=|=>|=(?![=~])|:(?![:/]))[ \t]*(?P<value>{_TERM}(?:[ \t]*\+[ \t]*{_TERM})*+)")
_PART = re.compile(_TERM)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

SPAN = "struct<kind:string,start:int,end:int,value_start:int,value_end:int>"
RESULT = f"doc_id bigint, spans array<{SPAN}>"


def name_weight(name: str) -> float:
    """How much a name says that what it holds is secret, from its words (camel case and separators)."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return max([0.0, *(NAME_WEIGHTS.get(w, 0.0) for w in words), *(PAIR_WEIGHTS.get(p, 0.0) for p in zip(words, words[1:]))])


#: Characters that a value keeps of its start and its end.
ENDS = 16
#: Characters up to which a joined value is counted exactly; beyond, counts are halved and keep their shares.
EXACT = 1 << 40


class _Value:
    """What a value needs for its score: its length, its ends, and how often each character occurs."""

    def __init__(self, text: str = ""):
        self.n, self.head, self.tail = len(text), text[:ENDS], text[-ENDS:]
        self.counts: dict[str, float] = Counter(text)

    def __add__(self, other: _Value) -> _Value:
        out = _Value()
        out.n = self.n + other.n
        out.head, out.tail = (self.head + other.head)[:ENDS], (self.tail + other.tail)[-ENDS:]
        out.counts = dict(self.counts)
        for c, n in other.counts.items():
            out.counts[c] = out.counts.get(c, 0) + n
        if out.n > EXACT:
            out.n, out.counts = out.n // 2, {c: n / 2 for c, n in out.counts.items()}
        return out

    def outline(self) -> str:
        """The text where it is short; else its ends with each character between them once, which matches the same placeholders."""
        if self.n <= 2 * ENDS:
            return self.head + self.tail[max(0, 2 * ENDS - self.n) :] if self.n > ENDS else self.head
        ends = Counter(self.head + self.tail)
        return self.head + "".join(c for c, n in self.counts.items() if n > ends[c]) + self.tail

    def score(self) -> float:
        counts, total = self.counts, sum(self.counts.values())
        if self.n < 8 or PLACEHOLDER.match(self.outline()) or any(c.isspace() for c in counts):
            return 0.0
        entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
        kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        if kinds < 2 or not any(c.isdigit() for c in counts):
            return 0.0
        return min(1.0, entropy / 3.5) * min(1.0, self.n / 12)


def literal_score(value: str) -> float:
    """0 to 1: length, variety of characters, and entropy; placeholders and plain words score 0."""
    return _Value(value).score()


class _Constant:
    """A name's value: spans and other constants, with their joined value made from theirs."""

    def __init__(self):
        self.parts: list[tuple[int, int] | _Constant] = []
        self.value = _Value()
        self.told = False

    def add(self, part: tuple[int, int] | _Constant, value: _Value) -> None:
        self.value = self.value + value if self.parts else value
        self.parts.append(part)

    def tell(self, found: set[tuple[int, int]]) -> None:
        """Adds all spans that the value comes from; a constant that was told before is not walked again."""
        left = [self]
        while left:
            node = left.pop()
            if not node.told:
                node.told = True
                found.update(p for p in node.parts if isinstance(p, tuple) and p[0] < p[1])
                left += [p for p in node.parts if isinstance(p, _Constant)]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, itself or through other names.

    A line costs what stands in it, however much its names already hold.
    """
    constants: dict[str, _Constant] = {}
    found: set[tuple[int, int]] = set()
    for pair in _PAIR.finditer(text):
        constant = _Constant()
        for part in _PART.finditer(text, pair.start("value"), pair.end("value")):
            start, end = part.span()
            quote = next((q for q in "\"'" if text[end - 1] == q and q in text[start : start + 3] and end - start > 1), "")
            if not quote and (known := constants.get(part.group())) is not None:
                constant.add(known, known.value)
                continue
            if quote:
                start, end = text.index(quote, start) + 1, end - 1
            constant.add((start, end), _Value(text[start:end]))
        name = pair.group("name")
        constants[name] = constant
        if (weight := name_weight(name)) and weight * constant.value.score() >= THRESHOLD:
            constant.tell(found)
    return sorted(found)


def spans_of(text: str) -> list[tuple[str, int, int, int, int]]:
    """All spans as (kind, start, end, value start, value end), by start, then kind as listed, then end."""
    spans = []
    raw = text.encode()
    low = raw.lower()
    if b"pass" in low or b"secret" in low or b"token" in low or b"api" in low:
        spans += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if b"AKIA" in raw:
        spans += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    spans += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    if b"=" in raw or b":" in raw:
        reach: list[tuple[int, int]] = []  # fixed spans by start, with the furthest end so far
        for _, a, b, _, _ in sorted(spans, key=lambda s: s[1]):
            reach.append((a, max(b, reach[-1][1] if reach else 0)))
        for a, b in lexed_spans(text):
            at = bisect_right(reach, (a, math.inf)) - 1
            if at < 0 or reach[at][1] < b:
                spans.append(("literal", a, b, a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32())])
    names = [f.name for f in kind]
    for batch in batches:
        rows = [[dict(zip(names, s)) for s in spans_of(text.as_py() or "")] for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: the secrets of its whole text, in code points.

    A null text counts as empty and gives no spans; a null id stays null;
    repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored. Spans of kind ``literal`` come from the lexer and are
    added only where no fixed pattern covers them.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, RESULT)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans, and all spans as text."""
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in KINDS if kind != "literal"],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"), of("literal").alias("n_literal"),
    )


def _redact(column: int, mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(x.as_py(), mask) for x in batch.column(column)]
            arrays = [pa.array(texts, pa.string()) if i == column else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


def redacted(text: str | None, mask: str) -> str | None:
    """``text`` with the value of every secret replaced; overlapping values are replaced once."""
    if not text:
        return text
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans_of(text)):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secret values masked in ``text_col``; all rows and columns stay."""
    return docs.mapInArrow(_redact(docs.columns.index(text_col), mask), docs.schema)
