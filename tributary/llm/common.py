"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(),
}

Columns = dict[str, list]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def give_back() -> None:
    """Return freed Arrow memory to the system: workers outlive their tasks, and the pool would keep it."""
    pa.default_memory_pool().release_unused()


def map_columns(frame: DataFrame, fields: dict[str, str], start: Callable[[], Callable[[Columns], Columns]]) -> DataFrame:
    """``frame`` turned into rows of ``fields``, a batch of columns at a time.

    ``start`` runs once in each task, so caches and models that it makes last for the task.
    """
    schema = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(step(batch.to_pydict()), schema=schema)

    return frame.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in fields.items()))


def filter_columns(frame: DataFrame, start: Callable[[], Callable[[Columns], list[bool]]], reads: list[str]) -> DataFrame:
    """The rows of ``frame`` for which the task's function of the columns ``reads`` says true; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in slices(batches):
            keep = step({name: batch.column(name).to_pylist() for name in reads})
            yield batch.filter(pa.array(keep, pa.bool_()))

    return frame.mapInArrow(run, frame.schema)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, A-Z lower-cased if asked: bytes know no other spaces and capitals."""
    if not text:
        return []
    return text.encode().lower().split() if lower else text.encode().split()


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def spans_text(spans: list[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` of (start, order of kind, kind, end), comma-joined in that order."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
