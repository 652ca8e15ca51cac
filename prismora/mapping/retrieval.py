"""Retrieval of one segment as a DataFrame step: nearest library rows, weights, reconstruction, fit and confidence.

Queries stay where they are while the library's features fit a bound that is checked: they are then shipped to the
tasks and each batch of queries is answered by matrix products, without a shuffle. Beyond the bound, blocks of queries
meet blocks of features as keyed rows, each pair gives its k best and a grouped limit keeps the k best of all. The
values to be combined (spectra, or band values of the target) are shipped under the same bound or joined by row.

queries: sample_index long, q array<double> (null: missing), valid array<boolean> (null: all), exclude_row long,
exclude_name long, and any other columns, which are kept. features: row_index, name_code, x. payload: row_index, y.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.arrays import appended, column, flags, lists, matrix
from . import kernels as K

SHIP_BYTES = 64 << 20  # of numpy arrays sent to every worker
BLOCK_BYTES = 16 << 20
QUERY_BLOCK = 20_000

FOUND = "struct<ok:boolean,reason:string,valid_count:int,total_count:int,rows:array<bigint>,distances:array<double>,weights:array<double>,bands:array<array<double>>,rmse:double,confidence:double,parts:array<double>,values:array<double>>"
INSUFFICIENT, EMPTY = "insufficient_valid_bands", "no_candidate_rows"
_ROWS = pa.list_(pa.int64())
_DOUBLES = pa.list_(pa.float64())


def bytes_of(df: DataFrame, col: str) -> int:
    """Size of an array column as doubles."""
    r = df.agg(F.count("*").alias("n"), F.max(F.size(col)).alias("w")).first()
    return int(r["n"]) * max(int(r["w"] or 0), 0) * 8


def shipped(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row_index, name_code, matrix) in row order; only for tables within SHIP_BYTES."""
    names = F.col("name_code") if "name_code" in df.columns else F.lit(None).cast("long").alias("name_code")
    t = df.select("row_index", names, col).toArrow()
    rows = t.column("row_index").to_numpy()
    order = np.argsort(rows)
    code = t.column("name_code").fill_null(-1).to_numpy()
    return rows[order], code[order], matrix(t.column(col))[order]


def _taken(batch: pa.RecordBatch, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid) of the segment's bands; missing values are not valid."""
    q = matrix(column(batch, "q"))
    ok = flags(column(batch, "valid"), q.shape[1]) & np.isfinite(q)
    return q[:, places], ok[:, places]


def _banned(batch: pa.RecordBatch, rows: np.ndarray, names: np.ndarray):
    own = column(batch, "exclude_row").fill_null(-1).to_numpy(zero_copy_only=False)
    name = column(batch, "exclude_name").fill_null(-2).to_numpy(zero_copy_only=False)
    if (own < 0).all() and (name < 0).all():
        return None
    return lambda part: (own[part, None] == rows[None, :]) | (name[part, None] == names[None, :])


def _packed(q: np.ndarray, ok: np.ndarray, rows: np.ndarray, far: np.ndarray, near: np.ndarray, least: int, estimator: str, values: np.ndarray | None) -> pa.Array:
    """The struct FOUND of a batch. near: (queries, k, bands) values of the neighbours; values: (queries, k, width) or None."""
    count = ok.sum(axis=1)
    used = np.isfinite(far)
    good = (count >= least) & used.any(axis=1)
    w = K.weights(estimator, near, far, q, ok)
    rmse = K.fit_rmse(w, near, q, ok)
    score, parts = K.confidence(q, ok, far, w, rmse)
    n, k = far.shape
    keep = used & good[:, None]
    ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
    bad = pa.array(~good)

    def cut(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x[keep], kind))

    bands = pa.ListArray.from_arrays(pa.array(ends), lists(near[keep]))
    out = [
        pa.array(good), pa.array([None if g else INSUFFICIENT if c < least else EMPTY for g, c in zip(good, count)], pa.string()), pa.array(count, pa.int32()), pa.array(np.full(n, ok.shape[1]), pa.int32()),
        cut(rows, pa.int64()), cut(far, pa.float64()), cut(w, pa.float64()), bands, pa.array(rmse, mask=~good), pa.array(np.where(good, score, 0.0)), lists(np.where(good[:, None], parts, 0.0)),
    ]
    names = ["ok", "reason", "valid_count", "total_count", "rows", "distances", "weights", "bands", "rmse", "confidence", "parts"]
    if values is None:
        blank = pa.nulls(n, _DOUBLES)
    else:
        made = lists(np.einsum("nk,nkw->nw", w, values))
        blank = pa.ListArray.from_arrays(made.offsets, made.values, mask=bad) if bad.true_count else made
    return pa.StructArray.from_arrays([*out, blank], names=[*names, "values"])


def _gathered(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of x at the places, zeros where a place is -1."""
    return np.where(at[:, :, None] >= 0, x[np.maximum(at, 0)], 0.0) if len(x) else np.zeros((*at.shape, x.shape[1]))


def retrieve(
    queries: DataFrame, out: str, features: DataFrame, payload: DataFrame | None, places: list[int], k: int, least: int = 1, estimator: str = "mean", ship_bytes: int = SHIP_BYTES, rows: int | None = None, width: int | None = None
) -> DataFrame:
    """queries with a struct column `out` (FOUND) for one segment. rows, width: of the library and of the payload's
    arrays, if they are known; otherwise they are counted.

    places: the queries' bands that are searched by, in the order of the features. A query with fewer than `least` valid
    ones, or without a candidate row, is not ok and has a reason. Distances are root mean squares over valid bands;
    ties go to the smaller row_index. payload None: nothing is combined.
    """
    if (bytes_of(features, "x") if rows is None else rows * len(places) * 8) > ship_bytes:
        return _beyond(queries, out, features, payload, places, k, least, estimator, ship_bytes)
    combine = payload is not None and (bytes_of(payload, "y") if rows is None or width is None else rows * width * 8) <= ship_bytes
    rows, names, x = shipped(features, "x")
    y = None
    if combine:
        at, _, y = shipped(payload, "y")
        y = y[np.searchsorted(at, rows)] if len(rows) else y  # payload rows are those of the features
    sent = queries.sparkSession.sparkContext.broadcast((rows, names, x, y))

    def run(batch: pa.RecordBatch) -> pa.Array:
        rows, names, x, y = sent.value
        q, ok = _taken(batch, places)
        parts = []
        for lo in range(0, len(q), 1024):
            part = batch.slice(lo, 1024)
            pq, pok = q[lo : lo + 1024], ok[lo : lo + 1024]
            at, far = K.nearest(pq, pok, x, rows, k, _banned(part, rows, names))
            far[pok.sum(axis=1) < max(least, 1)] = np.inf
            ids = rows[np.maximum(at, 0)] if len(rows) else at
            parts.append(_packed(pq, pok, ids, far, _gathered(x, at), least, estimator, None if y is None else _gathered(y, at)))
        return pa.concat_arrays(parts)

    found = appended(queries, out, FOUND, run)
    return found if combine or payload is None else rebuilt(found, out, payload)


def rebuilt(found: DataFrame, out: str, payload: DataFrame) -> DataFrame:
    """Fill `values` by a join with the payload: runs of a query's rows are summed batch by batch."""
    pairs = found.select("sample_index", F.inline(F.arrays_zip(F.col(f"{out}.rows").alias("row_index"), F.col(f"{out}.weights").alias("w"))))
    joined = pairs.join(payload.select("row_index", "y"), "row_index").select("sample_index", "w", "y")
    placed = joined.repartition("sample_index").sortWithinPartitions("sample_index")
    sums = placed.mapInArrow(_summed, "sample_index long, made array<double>")
    done = found.join(sums, "sample_index", "left")
    fields = [F.col(f"{out}.{f}").alias(f) for f in found.schema[out].dataType.names if f != "values"]
    return done.withColumn(out, F.struct(*fields, F.col("made").alias("values"))).drop("made")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(sums)], names=["sample_index", "made"])

    held, total = None, None
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            batch = whole.slice(lo, 2048)
            ids = column(batch, "sample_index").to_numpy()
            parts = column(batch, "w").to_numpy()[:, None] * matrix(column(batch, "y"))
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            sums, ids = np.add.reduceat(parts, first, axis=0), ids[first]
            if held is not None and ids[0] == held:
                sums[0] += total
            elif held is not None:
                yield emit(np.array([held]), total[None])
            if len(ids) > 1:
                yield emit(ids[:-1], sums[:-1])
            held, total = ids[-1], sums[-1]
    if held is not None:
        yield emit(np.array([held]), total[None])


def _beyond(queries: DataFrame, out: str, features: DataFrame, payload: DataFrame | None, places: list[int], k: int, least: int, estimator: str, ship_bytes: int) -> DataFrame:
    best = block_search(queries, features, places, k, max(least, 1))
    names = [f.name for f in queries.schema.fields]
    joined = queries.join(best, "sample_index", "left").select(*names, "near")

    def run(batch: pa.RecordBatch) -> pa.Array:
        q, ok = _taken(batch, places)
        n, b = q.shape
        near = column(batch, "near").to_pylist()
        rows, far, x = np.full((n, k), -1, np.int64), np.full((n, k), np.inf), np.zeros((n, k, b))
        for i, found in enumerate(near):
            for j, (r, d, v) in enumerate((f["row_index"], f["distance"], f["x"]) for f in found or []):
                rows[i, j], far[i, j], x[i, j] = r, d, v
        return _packed(q, ok, rows, far, x, least, estimator, None)

    found = appended(joined, out, FOUND, run).drop("near")
    return found if payload is None else rebuilt(found, out, payload)


def block_search(queries: DataFrame, features: DataFrame, places: list[int], k: int, least: int = 1, block_bytes: int = BLOCK_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(sample_index, near): the k nearest rows as an array of (distance, row_index, x), from pairs of blocks."""
    across = max(1, math.ceil(bytes_of(features, "x") / block_bytes))
    down = max(1, math.ceil(queries.count() / query_block))
    left = queries.select("sample_index", "q", "valid", "exclude_row", "exclude_name", F.pmod(F.xxhash64("sample_index"), F.lit(down)).cast("int").alias("i"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = features.select("row_index", "name_code", "x", F.pmod(F.xxhash64("row_index"), F.lit(across)).cast("int").alias("j"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    schema = "sample_index long, row_index long, distance double, x array<double>"

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        kinds = pa.schema([("sample_index", pa.int64()), ("row_index", pa.int64()), ("distance", pa.float64()), ("x", _DOUBLES)])
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        batch = a.combine_chunks().to_batches(max_chunksize=a.num_rows)[0]
        rows, names, x = b.column("row_index").to_numpy(), b.column("name_code").fill_null(-1).to_numpy(), matrix(b.column("x"))
        q, ok = _taken(batch, places)
        at, far = K.nearest(q, ok, x, rows, k, _banned(batch, rows, names))
        who, slot = np.nonzero(np.isfinite(far) & (ok.sum(axis=1) >= least)[:, None])
        row = at[who, slot]
        return pa.table([column(batch, "sample_index").take(pa.array(who)), pa.array(rows[row]), pa.array(far[who, slot]), lists(x[row])], schema=kinds)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pair, schema)
    best = Window.partitionBy("sample_index").orderBy("distance", "row_index")
    kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return kept.groupBy("sample_index").agg(F.array_sort(F.collect_list(F.struct("distance", "row_index", "x"))).alias("near"))
