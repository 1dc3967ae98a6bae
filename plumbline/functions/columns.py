"""Column naming, typing and row identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
NESTED = "nested"


@dataclass(frozen=True)
class ColumnInfo:
    pos: int
    name: str
    dtype: str
    role: str
    data_type: T.DataType

    @property
    def is_string(self) -> bool:
        return isinstance(self.data_type, T.StringType)

    @property
    def is_integral(self) -> bool:
        return isinstance(self.data_type, T.IntegralType)


def col(name: str) -> Column:
    """Column by its literal name; dots and backticks are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def role_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return NESTED
    return CATEGORICAL


def describe_columns(df: DataFrame) -> list[ColumnInfo]:
    return [
        ColumnInfo(i, f.name, f.dataType.simpleString(), role_of(f.dataType), f.dataType)
        for i, f in enumerate(df.schema.fields)
    ]


def comparable(df: DataFrame) -> list[str]:
    """Columns that whole-row comparison can use: all but those with maps."""

    def has_map(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        if isinstance(t, T.StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return isinstance(t, T.MapType)

    return [f.name for f in df.schema.fields if not has_map(f.dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give NaN and NULL one meaning: a missing value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def hash32(text: Column) -> Column:
    """First 32 bits of md5 as a non-negative bigint; the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
