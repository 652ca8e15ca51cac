"""Chunked Zarr (version 2, no compression) output of mapping results: every chunk is written by the task that has it."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RESULT, CodedError
from ..operators.arrays import matrix
from ..sources.files import delete, move_into_place, write_text
from ..streaming.chunks import chunk_rows

ID_CHARS = 64  # longest sample id


def _array(shape: list[int], chunks: list[int], dtype: str, fill: object) -> str:
    return json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": None, "filters": None, "order": "C", "fill_value": fill})


def write_zarr(results: DataFrame, path: str, axis_name: str, axis: Sequence, attributes: Mapping[str, object] | None = None, rows_a_chunk: int | None = None) -> int:
    """Write reflectance (samples, axis), source_fit_rmse and sample_id, and the axis; the number of samples.

    results: sample_index, the numbers 0..n-1 once each, sample_id, reflectance (null elements become NaN),
    source_fit_rmse. path: a URI that Hadoop and Arrow both reach. What was there is replaced when all is written.
    """
    spark, width = results.sparkSession, len(axis)
    n, distinct, low, high, longest = results.agg(F.count("*"), F.countDistinct("sample_index"), F.min("sample_index"), F.max("sample_index"), F.max(F.length("sample_id"))).first()
    if n and (distinct, low, high) != (n, 0, n - 1):
        raise CodedError(RESULT, "samples must be numbered 0 to n-1", found=[n, distinct, low, high])
    if (longest or 0) > ID_CHARS:
        raise CodedError(RESULT, "a sample id is too long", longest=longest, limit=ID_CHARS)
    size = rows_a_chunk or chunk_rows(0, width)
    size = max(1, min(size, max(n, 1)))
    temp = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    kinds = {"reflectance": ("<f8", [n, width], [size, max(width, 1)], "NaN"), "source_fit_rmse": ("<f8", [n], [size], "NaN"), "sample_id": (f"<U{ID_CHARS}", [n], [size], "")}
    write_text(spark, f"{temp}/.zgroup", json.dumps({"zarr_format": 2}))
    write_text(spark, f"{temp}/.zattrs", json.dumps(dict(attributes or {}) | {"axis": axis_name}, sort_keys=True))
    for name, (dtype, shape, chunks, fill) in kinds.items():
        write_text(spark, f"{temp}/{name}/.zarray", _array(shape, chunks, dtype, fill))
    coord = np.array(axis, f"<U{max(map(len, map(str, axis)), default=1)}") if axis and isinstance(axis[0], str) else np.array(axis, "<f8")

    def put(folder: str, part: str, body: bytes) -> None:
        fs, base = pafs.FileSystem.from_uri(f"{temp}/{folder}")
        fs.create_dir(base, recursive=True)
        own = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(body)
        fs.move(own, f"{base}/{part}")  # a task that is run again replaces its own chunk

    def chunk(rows: pa.Table) -> pa.Table:
        at = rows.column("sample_index").to_numpy()
        number = int(at[0]) // size
        values, rmse, ids = np.full((size, width), np.nan), np.full(size, np.nan), np.zeros(size, f"<U{ID_CHARS}")
        place = at - number * size
        values[place] = matrix(rows.column("reflectance"), width)
        rmse[place] = rows.column("source_fit_rmse").to_numpy()
        ids[place] = [s or "" for s in rows.column("sample_id").to_pylist()]
        put("reflectance", f"{number}.0", values.astype("<f8").tobytes())
        put("source_fit_rmse", str(number), rmse.astype("<f8").tobytes())
        put("sample_id", str(number), ids.tobytes())
        return pa.table({"chunk": pa.array([number], pa.int64()), "rows": pa.array([len(at)], pa.int64())})

    try:
        put(axis_name, "0", coord.tobytes())
        write_text(spark, f"{temp}/{axis_name}/.zarray", _array([width], [max(width, 1)], coord.dtype.str, None))
        given = results.select("sample_index", "sample_id", "reflectance", F.col("source_fit_rmse").cast("double").alias("source_fit_rmse"))
        placed = given.withColumn("chunk", F.floor(F.col("sample_index") / size)).repartition(max(1, min(math.ceil(n / size), 10_000)), "chunk")
        done = placed.groupBy("chunk").applyInArrow(chunk, "chunk long, rows long").agg(F.sum("rows")).first()[0] or 0
        if done != n:
            raise CodedError(RESULT, "not all samples were written", wanted=n, written=done)
        move_into_place(spark, temp, path)
    except Exception:
        delete(spark, temp)
        raise
    return n
