"""Dates in text: the shape of every value, and what the whole column tells about the order of day and month.

The shape depends on a value's layout alone, that is on the value with every digit
alike. Patterns are tried once a layout; they tell where the digits of year, month
and day stand, and numbers are then read off whole batches of values at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col

MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WEEKDAY = r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b[.,]?"
TIME = r"(?:^|[t ]+)\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]m)?\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?(?= |$)"
DAY = r"(\d{1,2})(?:st|nd|rd|th)?"

#: Shape -> pattern of what is left without time and weekday, and the groups of year, month and day; day 0 is the first of the month.
SHAPES = {
    "year-month-day": (r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", 1, 2, 3),
    "yearmonthday": (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    "year-month": (r"^(\d{4})[-/](\d{1,2})$", 1, 2, 0),
    "number-number-year": (r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})$", 3, 1, 2),
    "day-name-year": (rf"^{DAY}[-/. ]*{MONTH}[-/. ]*(\d{{4}}|\d{{2}})$", 3, 2, 1),
    "name-day-year": (rf"^{MONTH}[-/. ]*{DAY}[-/. ]+(\d{{4}})$", 3, 1, 2),
    "name-year": (rf"^{MONTH}[-/. ]*(\d{{4}})$", 2, 1, 0),
    "year-name-day": (rf"^(\d{{4}})[-/. ]*{MONTH}[-/. ]*(\d{{1,2}})$", 1, 2, 3),
}
OPEN = "number-number-year"
TIMED_YEAR = "year"


MAX_LENGTH = 64
#: Layouts that a task remembers.
LAYOUTS = 100_000
#: The end of a text, or the line end before it.
END = "(?=(?:\r\n|(?<!\r)\n|[\r\u0085\u2028\u2029])?\\Z)"
NAMES = [*SHAPES, TIMED_YEAR]


class Layout(NamedTuple):
    """What every value of a layout has in common: the shape (-1: none), the places of four digits of the year, two of
    the month and two of the day (-1: a zero), and the month and day where no digits tell them."""

    shape: int
    digits: tuple[int, ...]
    month: int
    day: int
    short_year: bool


NO_DATE = Layout(-1, (-1,) * 8, 0, 0, False)


@cache
def _patterns() -> tuple:
    """Compiled patterns; they are of letters, white space and digits of ASCII, but words end as Unicode has it."""
    ends = lambda p: p.replace("$", END)
    gaps = (re.compile(WEEKDAY), re.compile(ends(TIME), re.ASCII), re.compile(r"[,\s]+", re.ASCII))
    return gaps, re.compile(ends(r"^\d{4}$"), re.ASCII), [(re.compile(ends(p), re.ASCII), y, m, d) for p, y, m, d in SHAPES.values()]


def _layout(text: str) -> Layout:
    """The layout of a text whose digits are all 0, by what is left without weekday, time and commas."""
    gaps, year, shapes = _patterns()
    at = np.cumsum([0, *(len(c.encode()) for c in text)])[:-1].tolist()
    rest = text
    for gap in gaps:
        parts, places, last = [], [], 0
        for m in gap.finditer(rest):
            parts += [rest[last : m.start()], " "]
            places += [*at[last : m.start()], -1]
            last = m.end()
        rest, at = "".join([*parts, rest[last:]]), [*places, *at[last:]]
    left = len(rest) - len(rest.lstrip(" "))
    rest, at = rest.strip(" "), at[left:]
    if ":" in text and year.search(rest):
        return Layout(len(SHAPES), (*at[:4], -1, -1, -1, -1), 1, 1, False)
    for shape, (pattern, *groups) in enumerate(shapes):
        m = pattern.search(rest)
        if m:
            digits, month, day = [], 0, 0
            for group, size in zip(groups, (4, 2, 2)):
                found = at[m.start(group) : m.end(group)] if group else []
                if group and not m[group].isdecimal():
                    month, found = MONTHS.index(m[group][:3]) // 3 + 1, []
                digits += [-1] * (size - len(found)) + found
            return Layout(shape, tuple(digits), month, 0 if groups[2] else 1, m.end(groups[0]) - m.start(groups[0]) == 2)
    return NO_DATE


class _Reader:
    """Reads the values of a task; it remembers the layouts that it has met."""

    def __init__(self):
        self.met: dict[str, Layout] = {}

    def _known(self, text: str) -> Layout:
        found = self.met.get(text)
        if found is None:
            if len(self.met) >= LAYOUTS:
                self.met.clear()
            found = self.met[text] = _layout(text) if "0" in text else NO_DATE
        return found

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Shape, year, month and day of every text as they stand there; texts are cleared and of at most ``MAX_LENGTH``, or null."""
        coded = texts.cast(pa.string()).dictionary_encode()
        values = coded.dictionary
        if not len(values):
            return tuple(np.full(len(texts), v) for v in (-1, 0, 0, 0))
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
        digit = (data >= 48) & (data <= 57)
        alike = pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets.copy()), pa.py_buffer(np.where(digit, np.uint8(48), data))])
        laid = alike.dictionary_encode()
        layouts = [self._known(t) for t in laid.dictionary.to_pylist()]
        mine = laid.indices.to_numpy()
        places = np.array([x.digits for x in layouts], dtype=np.int64)[mine]
        read = np.where(places >= 0, data[np.maximum(offsets[:-1, None] + places, 0) % max(1, len(data))].astype(np.int64) - 48, 0) if len(data) else places * 0
        shape, fixed_month, fixed_day, short = (np.array([x[i] for x in layouts], dtype=np.int64)[mine] for i in (0, 2, 3, 4))
        year = read[:, :4] @ np.array([1000, 100, 10, 1])
        year = np.where(short > 0, year + np.where(year < 69, 2000, 1900), year)  # between 1969 and 2068
        month, day = read[:, 4:6] @ np.array([10, 1]) + fixed_month, read[:, 6:] @ np.array([10, 1]) + fixed_day
        place = coded.indices.fill_null(len(values)).to_numpy()
        return tuple(np.r_[v, none][place] for v, none in ((shape, -1), (year, 0), (month, 0), (day, 0)))

    def days(self, texts: pa.Array, turned: bool) -> pa.Array:
        shape, year, month, day = self.numbers(texts)
        first, is_first = _calendar(year, month, day)
        other, is_other = _calendar(year, day, month)
        is_other &= shape == NAMES.index(OPEN)
        if turned:
            found = np.where(is_other, other, first)
        else:
            found = np.where(is_first, first, other)
        known = (shape >= 0) & (is_first | is_other)
        return pa.array(np.where(known, found, 0).astype(np.int32), pa.int32(), mask=~known).cast(pa.date32())


def _calendar(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether the calendar has such a day."""
    months = ((year - 1970) * 12 + month - 1).astype("datetime64[M]")
    days = months.astype("datetime64[D]").astype(np.int64) + day - 1
    same = days.astype("datetime64[D]").astype("datetime64[M]") == months
    return days, same & (month > 0) & (month < 13) & (day > 0)


def _cleared(text: Column) -> Column:
    return F.when(F.length(text) <= MAX_LENGTH, F.lower(F.trim(text)))


def shape_of(text: Column) -> Column:
    """Name of the shape, or NULL where none fits."""
    reader = _Reader()
    names = pa.array([*NAMES, None], pa.string())

    @F.arrow_udf("string")
    def named(texts: pa.Array) -> pa.Array:
        shape = reader.numbers(texts)[0]
        return names.take(pa.array(np.where(shape < 0, len(NAMES), shape)))

    return named(_cleared(text))


def day_of(text: Column, turned: bool = False) -> Column:
    """Date that the text spells, else NULL; see ``parse``."""
    reader = _Reader()

    @F.arrow_udf("date")
    def read(texts: pa.Array) -> pa.Array:
        return reader.days(texts, turned)

    return read(_cleared(text))


def parse(text: Column, day_first: Column | bool = False) -> Column:
    """Timestamp of the day that the text spells, else NULL. Parts that it leaves out are the first; times and zones are ignored.

    Of two leading numbers the month comes first, unless ``day_first`` holds or only the other order is a date.
    """
    if isinstance(day_first, bool):
        return day_of(text, day_first).cast("timestamp")
    return F.when(day_first, day_of(text, True)).otherwise(day_of(text)).cast("timestamp")


def date_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, shape, rows, day_first, month_first``: how often each shape occurs, and of the open ones, how many have one order only.

    One scan for all columns; a task sends a row a column and shape.
    """
    texts = df.select(*[_cleared(col(c).cast("string")).alias(f"t{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = _Reader(), np.zeros((3, len(columns), len(NAMES)), dtype=np.int64)
        for batch in batches:
            for p, column in enumerate(batch.columns):
                shape, _, a, b = reader.numbers(column)
                open_ones = shape == NAMES.index(OPEN)
                for count, counted in zip(counts, (shape >= 0, open_ones & (a > 12), open_ones & (b > 12))):
                    count[p] += np.bincount(shape[counted], minlength=len(NAMES))
        p, s = np.nonzero(counts[0])
        if len(p):
            named = [pa.array([names[i] for i in at], pa.string()) for names, at in ((columns, p), (NAMES, s))]
            yield pa.RecordBatch.from_arrays([*named, *(pa.array(c[p, s]) for c in counts)], ["column", "shape", "rows", "day_first", "month_first"])

    found = texts.mapInArrow(run, "column string, shape string, rows bigint, day_first bigint, month_first bigint")
    return found.groupBy("column", "shape").agg(*[F.sum(c).alias(c) for c in ("rows", "day_first", "month_first")])


def day_first(df: DataFrame, columns: list[str]) -> set[str]:
    """The columns whose open dates more often need the day first than the month."""
    if not columns:
        return set()
    rows = date_shapes(df, columns).where((F.col("shape") == OPEN) & (F.col("day_first") > F.col("month_first")))
    return {r["column"] for r in rows.select("column").collect()}
