"""Intermediates that several steps read, as tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.functions.frames import materialise


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table, so that a lost executor costs a task and not the steps before.

    Shuffle files of the steps behind it are no longer needed; Spark removes
    them once the driver has let go of their plans.
    """
    table = materialise(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on and wait beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
