"""Series kernels over a table: one Arrow batch at a time, no shuffle, every other column kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import appended, lists, matrix
from .arrays import column as arrow_column

Kernel = Callable[[np.ndarray], np.ndarray | None]


def mapped(df: DataFrame, column: str, kernel: Kernel, out: str = "values", whole: bool = False) -> DataFrame:
    """df with array<double> `out`, the kernel's result on `column`; null where that is null or the kernel gives none.

    whole: the kernel takes a matrix, the rows of a batch that have one length, and gives one of as many rows.
    """

    def by_length(column: pd.Series) -> list:
        done: list = [None] * len(column)
        sizes = np.array([-1 if y is None else len(y) for y in column])
        for n in set(sizes[sizes >= 0].tolist()):
            at = np.flatnonzero(sizes == n)
            for lo in range(0, len(at), 1024):
                rows = at[lo : lo + 1024]
                for k, z in zip(rows, kernel(np.array([column.iloc[k] for k in rows], float))):
                    done[k] = z
        return done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            done = by_length(d[column]) if whole else [None if y is None else kernel(np.array(y, float)) for y in d[column]]
            yield d.assign(**{out: pd.Series([None if z is None else np.asarray(z, float) for z in done], index=d.index, dtype=object)})

    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select([f.name for f in fields]).mapInPandas(lambda b: (d[schema.names] for d in run(b)), schema)


def _gaps(y: np.ndarray) -> np.ndarray:
    """Rows of missing, leading, trailing, internal, longest internal run, for each row of a matrix."""
    bad = ~np.isfinite(y)
    n = y.shape[1]
    some = ~bad.all(axis=1)
    lead = np.where(some, (~bad).argmax(axis=1), n)
    trail = np.where(some, (~bad[:, ::-1]).argmax(axis=1), n)
    place = np.arange(n)
    inner = bad & (place >= lead[:, None]) & (place < (n - trail)[:, None])
    last_good = np.maximum.accumulate(np.where(inner, -1, place), axis=1)
    return np.stack([bad.sum(axis=1), lead, trail, inner.sum(axis=1), np.where(inner, place - last_good, 0).max(axis=1, initial=0)], axis=1)


def gap_counts(df: DataFrame, column: str) -> DataFrame:
    """df with struct `gaps`: missing, leading, trailing, internal places and the longest run of internal ones."""
    names = ["missing", "leading", "trailing", "internal", "longest"]

    def run(batch: pa.RecordBatch) -> pa.Array:
        found = _gaps(matrix(arrow_column(batch, column)))
        return pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(5)], names=names)

    return appended(df, "gaps", "struct<" + ",".join(f"{n}:bigint" for n in names) + ">", run)


def gap_filled(df: DataFrame, column: str) -> DataFrame:
    """df with the column's missing places on the line between their neighbours, edges held; a row without a value stays."""

    def run(batch: pa.RecordBatch) -> pa.Array:
        y = matrix(arrow_column(batch, column))
        x = np.arange(y.shape[1])
        for k in np.flatnonzero(~np.isfinite(y).all(axis=1)):
            ok = np.isfinite(y[k])
            if ok.any():
                y[k] = np.interp(x, x[ok], y[k][ok])
        return lists(y)

    return appended(df, column, "array<double>", run)
