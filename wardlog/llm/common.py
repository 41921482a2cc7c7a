"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside a task, so that Python objects of one slice stay small whatever the Arrow batch size is.
SLICE_ROWS = 512

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task in pieces of at most SLICE_ROWS rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def rows_out(schema: pa.Schema, columns: list[list[Any]]) -> pa.RecordBatch:
    """One record batch from Python lists in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_slices(frame: DataFrame, function: Callable[[pa.RecordBatch], list[list[Any]]], ddl: str, arrow: pa.Schema) -> DataFrame:
    """Apply `function` to small pieces of every partition; it returns the output columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield rows_out(arrow, function(piece))

    return frame.mapInArrow(run, ddl)


def keep_rows(frame: DataFrame, text_col: str, decide: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Filter all columns of `frame` by a verdict on the text alone; no shuffle, no join back."""
    at = frame.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield piece.filter(pa.array(decide(piece.column(at).to_pylist()), type=pa.bool_()))

    return frame.mapInArrow(run, frame.schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a name inside an expression, so that it is computed once however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
