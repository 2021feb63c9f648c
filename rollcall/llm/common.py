"""Shared plumbing: Arrow helpers, hash splits and memos; tables and components are the library's own."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import materialise, shared_dir

__all__ = ["BoundedCache", "agreed_labels", "connected_components", "filtered", "hash_split", "kept", "materialise", "raw_texts", "shared_dir", "sliced", "texts", "tidied"]


def hash_split(column: str, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def agreed_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) of ids that are not null and whose labels, of those that are 0 or 1, all agree."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1))
    return known.groupBy(id_col).agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as the empty string."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column as UTF-8 bytes, null as empty, without building Python strings."""
    col = batch.column(batch.schema.get_field_index(column))
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


class BoundedCache(dict):
    """Memo of two generations of ``limit`` entries: what was used since the last change of generation survives it.

    Keys longer than ``longest`` are computed each time, which bounds the memo's bytes.
    """

    def __init__(self, compute, limit: int = 400_000, longest: int = 128):
        super().__init__()
        self._compute, self._limit, self._longest, self._old = compute, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self._longest:
            return self._compute(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        self[key] = value
        return value


_kept: dict[Hashable, object] = {}  # by this worker, of one kind of task


def let_go(keeps: Hashable = None) -> None:
    """Drop what this worker keeps, unless it is ``keeps``, and give freed memory back to the system."""
    if _kept and keeps not in _kept:
        _kept.clear()
        gc.collect()  # memos hold their owner's methods
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def kept[T](key: Hashable, make: Callable[[], T]) -> T:
    """``make()``, kept for this worker's later tasks of the same kind, until one of another kind comes.

    A worker serves every stage of a run, and would else hold the sum of what all of them kept.
    """
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def tidied(batches: Iterable[pa.RecordBatch], keeps: Hashable = None) -> Iterator[pa.RecordBatch]:
    """The batches of a task that uses of what its worker keeps only ``keeps``; before and after them, the rest is let go."""
    let_go(keeps)
    yield from batches
    let_go(keeps)


def sliced(batches: Iterable[pa.RecordBatch], rows: int, keeps: Hashable = None) -> Iterator[pa.RecordBatch]:
    """The batches, ``tidied``, cut to at most ``rows`` rows: bounds what Python holds at once."""
    for batch in tidied(batches, keeps):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def filtered(df: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows of ``df`` that a judge keeps, all columns as they were, in one narrow stage.

    ``judge()`` is called once a task and returns a function from texts to a boolean array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for batch in sliced(batches, 128):
            yield batch.filter(pa.array(keeps(texts(batch, text_col)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
