"""Helpers that the operators share: appending columns per Arrow batch, shared storage, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rostrum.session import shared_folder, stored  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A-Z to lower case; all ASCII but letters and digits to a space. Bytes from 0x80 stay, so UTF-8 letters hold together.
WORD_BYTES = bytes(
    (b + 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query, with its checking SQL if there is one."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def fields(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def add_columns(df: DataFrame, sources: Sequence[str], fn: Callable, schema: str | T.StructType,
                keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed batch by batch in Python; no shuffle.

    ``fn`` gets one Arrow array per source column and returns one list or array per new
    column. ``keep`` names the input columns to pass on (default all). An input column
    whose name a new one takes is replaced by it.
    """
    new = fields(schema)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    need = list(dict.fromkeys([*kept, *sources]))
    df = df.select(*[F.col(f"`{c}`") for c in need])
    out = T.StructType([*(df.schema[c] for c in kept), *new])
    types = [to_arrow_type(f.dataType) for f in new]
    names = [*kept, *(f.name for f in new)]
    at = [need.index(c) for c in sources]

    def run(batches):
        for b in batches:
            made = fn(*(b.column(i) for i in at))
            made = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *made], names=names)
        give_back_memory()

    return df.mapInArrow(run, out)


def map_batches(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """``fn`` turns an iterator of Arrow batches into lists of columns, each a block of new rows."""
    out = fields(schema)
    types, names = [to_arrow_type(f.dataType) for f in out], out.fieldNames()

    def run(batches):
        for cols in fn(batches):
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back_memory()

    return df.mapInArrow(run, out)


def give_back_memory() -> None:
    """At the end of a task: workers are used again, and what they keep would count against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [b or b"" for b in col.cast(pa.binary()).to_pylist()]


def as_text(col: pa.Array) -> list[str]:
    return [t or "" for t in col.to_pylist()]
