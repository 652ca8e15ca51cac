"""Array columns as numpy matrices, an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from ..errors import LIBRARY, CodedError


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix, nulls as NaN; a null row is all NaN. Rows must be of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    known = ~np.isnan(sizes.astype(float))
    width = width if width is not None else int(sizes[known][0]) if known.any() else 0
    if (sizes[known] != width).any():
        raise CodedError(LIBRARY, "arrays of a column differ in length", expected=width)
    out = np.full((n, width), np.nan)
    out[known] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width) if width else 0.0
    return out


def flags(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list of booleans; a null row is all true, a null element false."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.ones((len(column), width), bool)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten().fill_null(False).to_numpy(zero_copy_only=False)
    out[known] = values.reshape(-1, width) if width else True
    return out


def lists(values: np.ndarray, kind: pa.DataType = pa.float64(), blank: bool = True) -> pa.Array:
    """A matrix as a list column; NaN becomes null where `blank`."""
    n, width = values.shape
    flat = np.ascontiguousarray(values).ravel()
    items = pa.array(flat, kind, from_pandas=blank) if flat.dtype.kind == "f" else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), items)


def appended(df: DataFrame, name: str, kind: str, kernel: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """df with one more column (or with that column replaced), made from whole batches."""
    fields = [f for f in df.schema.fields if f.name != name]
    schema = StructType([*fields, StructField(name, DataType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, kernel(batch)], names=[*[f.name for f in fields], name])

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def projected(df: DataFrame, values: str, weights: np.ndarray, out: str) -> DataFrame:
    """df with `out`: the rows of `values` times a matrix; a row with a null has nulls."""
    return appended(df, out, "array<double>", lambda b: lists(matrix(column(b, values), weights.shape[0]) @ weights))
