"""Shared helpers: tables written to the shared folder, and Arrow scans over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c):
    return F.coalesce(c, F.lit(""))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and is computed only once.

    Unlike ``checkpoint()`` the plan runs a single time, and the table is columnar, so later reads
    take the columns they need.  It survives lost executors, as the folder is shared.
    """
    path = scratch_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


_TABLE: dict = {}


def worker_table(key, make: Callable):
    """The one large table that a Python worker keeps between tasks; asking for another drops it first."""
    release(key)
    if key not in _TABLE:
        _TABLE[key] = make()
    return _TABLE[key]


def release(but=None):
    """Drop the worker's table unless its key is ``but``."""
    if but not in _TABLE:
        _TABLE.clear()


def scan(df: DataFrame, fields: Iterable[T.StructField], column: str,
         fn: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None, table=None) -> DataFrame:
    """Add columns computed from one column, an Arrow batch at a time; no shuffle.

    ``keep`` names the input columns that pass through untouched (all by default).  ``fn`` gets the
    column of a batch and returns one array per field.  Each row is handled by itself, so repeated
    ids and lost executors do not matter.  ``table`` is the key under which ``fn`` keeps its ``worker_table``;
    what an earlier step left in a reused worker is dropped.
    """
    keep = df.columns if keep is None else keep
    cols = keep if column in keep else [*keep, column]
    df = df.select(*[F.col(f"`{c}`") for c in cols])
    fields = list(fields)
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    n, at, names = len(keep), cols.index(column), schema.names

    def run(batches):
        release(table)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *fn(b.column(at))], names=names)

    return df.mapInArrow(run, schema)
