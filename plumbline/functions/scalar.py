"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that a CSV reader takes for a missing value.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Fixed value: text that reads as a number, infinities included.
NUMERIC_TEXT = r"(?i)^[ \t]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity)[ \t]*$"


def round_stat(c: Column, digits: int = 4) -> Column:
    """Round to ``digits`` decimals at any size; non-finite becomes NULL."""
    return F.when(finite_test(c), F.round(c, digits))


def finite_test(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(finite_test(c), c)


def missing_token_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*MISSING_TOKENS), c)


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC_TEXT)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; 0 when ``whole`` is 0."""
    return F.round(
        F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)) * 100, digits
    )


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", F.round(c, 1))
