"""Linear maps by normal equations, summed in Spark: any number of rows, one small matrix on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import INPUT, CodedError
from ..operators.arrays import column, matrix, projected
from ..streaming.chunks import chunk_rows

CELLS = 64 << 20  # numbers of the summed products on the driver, at most


@dataclass
class LinearMapper:
    weights: np.ndarray  # (inputs, outputs)
    bias: np.ndarray

    def apply(self, df: DataFrame, values: str = "values", out: str = "reflectance") -> DataFrame:
        """df with the mapped array; a row with a null has nulls."""
        made = projected(df, values, self.weights, "_raw")
        shift = F.lit(self.bias.tolist())
        return made.withColumn(out, F.zip_with("_raw", shift, lambda a, b: a + b)).drop("_raw")

    def map_array(self, rows: np.ndarray, dtype: str = "float64") -> np.ndarray:
        """A matrix in memory, a chunk of bounded size at a time."""
        rows = np.asarray(rows)
        if rows.ndim != 2 or rows.shape[1] != len(self.weights):
            raise CodedError(INPUT, "rows must be a matrix with a column a source band", shape=list(rows.shape), bands=len(self.weights))
        out = np.empty((len(rows), len(self.bias)), dtype)
        step = chunk_rows(rows.shape[1], len(self.bias), out.itemsize)
        for lo in range(0, len(rows), step):
            out[lo : lo + step] = rows[lo : lo + step] @ self.weights + self.bias
        return out


def moments(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(D'D, D'Y) of the design D = (1, x) and the outputs y, over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x, y = matrix(column(batch, "x")), matrix(column(batch, "y"))
                d = np.c_[np.ones(len(x)), x]
                part = d.T @ np.c_[d, y]
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.full(total.size, len(total))), pa.array(total.ravel())], names=["at", "side", "s"])

    sums = pairs.select("x", "y").mapInArrow(partial, "at long, side long, s double").groupBy("at").agg(F.max("side").alias("side"), F.sum("s").alias("s"))
    r = pairs.select(F.size("x").alias("a"), F.size("y").alias("b")).first()
    if r is None:
        raise CodedError(INPUT, "no rows to fit a linear map on")
    if (r["a"] + 1) * (r["a"] + 1 + r["b"]) > CELLS:
        raise CodedError(INPUT, "the linear map is too wide for one machine", inputs=r["a"], outputs=r["b"])
    t = sums.toArrow().sort_by("at")
    both = t.column("s").to_numpy().reshape(r["a"] + 1, -1)
    return both[:, : r["a"] + 1], both[:, r["a"] + 1 :]


def fit(pairs: DataFrame) -> LinearMapper:
    """Least squares of y on x with a constant; rank-deficient designs get the smallest solution."""
    a, b = moments(pairs)
    try:
        c = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        c = np.linalg.pinv(a) @ b
    return LinearMapper(c[1:], c[0])
