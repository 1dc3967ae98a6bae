"""Folders of Parquet, JSON or CSV files whose columns differ: put together by name, with types widened or the clash reported."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col
from plumbline.sources.csv import BadInput, read_csv

#: Types from narrow to wide: a column takes the widest that its files have.
WIDER = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class Clash:
    """A column that files hold in types without a common one."""

    column: str
    types: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.column}: {', '.join(self.types)}"


def common_type(types: set[str]) -> str | None:
    """The narrowest type that holds all of them without loss of kind, or None.

    Numbers widen up to double, dates to timestamps; anything else only meets
    itself. Booleans are no numbers.
    """
    types = types - {"void"}
    if len(types) <= 1:
        return next(iter(types), "string")
    if types <= set(WIDER[1:]):
        widest = max(types, key=WIDER.index)
        # a float does not hold what an int or bigint does
        return "double" if widest == "float" and types & {"int", "bigint"} else widest
    if all(t.startswith("decimal") or t in WIDER[1:5] for t in types):
        return _decimal(types)
    if types <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp" if "timestamp" in types else "timestamp_ntz"
    return None


def _decimal(types: set[str]) -> str | None:
    digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
    parts = [T._parse_datatype_string(t) if t.startswith("decimal") else T.DecimalType(digits[t], 0) for t in types]
    scale = max(p.scale for p in parts)
    whole = max(p.precision - p.scale for p in parts)
    return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else None


def reconcile(parts: list[DataFrame], clashes: str = "fail") -> DataFrame:
    """One table of all parts: columns by name in order of appearance, absent ones null, types widened.

    Names that differ in case only are one column. A column without a common type
    is an error that names all such columns, or with ``clashes="text"`` becomes text.
    """
    if clashes not in ("fail", "text"):
        raise ValueError(f"unknown rule for clashes: {clashes!r}")
    if not parts:
        raise BadInput("there are no files to read")
    names: dict[str, str] = {}
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema.fields:
            names.setdefault(f.name.lower(), f.name)
            kinds.setdefault(f.name.lower(), set()).add(f.dataType.simpleString())
    wide = {c: common_type(k) for c, k in kinds.items()}
    bad = [Clash(names[c], tuple(sorted(kinds[c]))) for c, t in wide.items() if t is None]
    if bad and clashes == "fail":
        raise BadInput("columns without a common type: " + "; ".join(map(str, bad)))

    def aligned(part: DataFrame) -> DataFrame:
        have = {c.lower(): c for c in part.columns}
        cells = []
        for key, name in names.items():
            cell = col(have[key]) if key in have else F.lit(None)
            cells.append(cell.cast(wide[key] or "string").alias(name))
        return part.select(*cells)

    return reduce(DataFrame.unionByName, [aligned(p) for p in parts])


def read_folder(spark: SparkSession, path: str, kind: str, clashes: str = "fail") -> DataFrame:
    """All ``kind`` files (parquet, json or csv) under ``path`` as one table, by column name.

    Schemas are found by distributed passes: footers of Parquet files, types of
    JSON values, headers of CSV files. Only where Parquet types differ are the
    files told apart. CSV files of one header have their types inferred together,
    so a column of theirs that is text anywhere is text; types of files with other
    headers are widened or clash. An empty folder is an error; a file without rows
    adds nothing.
    """
    readers = {"parquet": _parquet, "json": _json, "csv": _csv}
    if kind not in readers:
        raise BadInput(f"only {', '.join(readers)} files are read, not {kind}")
    if spark.read.format("binaryFile").options(**_inside(kind)).load(path).select("path").isEmpty():
        raise BadInput(f"{path} has no .{kind} files")
    return readers[kind](spark, path, clashes)


def _inside(kind: str) -> dict:
    return {"recursiveFileLookup": True, "pathGlobFilter": f"*.{kind}"}


def _parquet(spark: SparkSession, path: str, clashes: str) -> DataFrame:
    try:
        return reconcile([spark.read.options(**_inside("parquet"), mergeSchema=True).parquet(path)], clashes)
    except Exception as failure:  # of a kind that differs between kinds of sessions
        if "CANNOT_MERGE" not in str(failure):
            raise
    groups: dict[str, list[str]] = {}
    files = spark.read.format("binaryFile").options(**_inside("parquet")).load(path).select("path").orderBy("path").collect()
    for r in files:
        groups.setdefault(spark.read.parquet(r["path"]).schema.json(), []).append(r["path"])
    return reconcile([spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*fs) for s, fs in groups.items()], clashes)


def _json(spark: SparkSession, path: str, clashes: str) -> DataFrame:
    """Spark widens numbers as it infers; what it turns to text although some values are none is a clash."""
    rows = spark.read.options(**_inside("json")).json(path)
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts and clashes == "fail":
        value = F.try_parse_json("value")
        kind = lambda c: F.schema_of_variant(F.try_variant_get(value, "$['" + c.replace("'", "\\'") + "']", "variant"))
        found = spark.read.options(**_inside("json")).text(path).agg(*[F.collect_set(kind(c)).alias(f"k{i}") for i, c in enumerate(texts)]).first()
        bad = [Clash(c, tuple(sorted(set(found[f"k{i}"]) - {"VOID"}))) for i, c in enumerate(texts) if set(found[f"k{i}"]) - {"VOID", "STRING"}]
        if bad:
            raise BadInput("columns without a common type: " + "; ".join(map(str, bad)))
    return reconcile([rows], clashes)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of every file; lines of a file arrive together and in order."""
    now = None
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        first = [i for i, (f, s) in enumerate(zip(files, starts)) if s == 0 and f != (files[i - 1] if i else now)]
        now = files[-1] if files else now
        if first:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), batch.column(2).take(pa.array(first))], ["path", "header"])


def _csv(spark: SparkSession, path: str, clashes: str) -> DataFrame:
    lines = spark.read.options(**_inside("csv")).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    heads = lines.mapInArrow(_headers, "path string, header string").orderBy("path").collect()
    groups: dict[str, list[str]] = {}
    for r in heads:
        groups.setdefault(r["header"], []).append(r["path"])
    parts, empty = [], None
    for files in groups.values():
        try:
            parts.append(read_csv(spark, files))
        except BadInput as failure:
            if "no data rows" not in str(failure):
                raise
            empty = failure
    if not parts and empty:
        raise empty
    return reconcile(parts, clashes)
