"""Approximate nearest neighbours: rows dealt to the cells of k-means centers, a few cells probed, distances exact.

The centers are fitted on a bounded sample of rows; every row is then put in its nearest cell, and the index can be
written and opened again. A query meets the rows of the `probes` cells nearest to it, in blocks of bounded size, so a
cell may hold any share of the rows; the k best of all are a grouped limit. Distances are those of the exact join.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import INPUT, CodedError
from ..mapping import kernels
from ..sources.files import read_text, write_text
from .arrays import appended, column, lists, matrix

SAMPLE = 50_000  # rows that the centers are fitted on, at most
BLOCK_ROWS = 20_000
BACKENDS = ("scipy_ckdtree", "faiss", "pynndescent", "scann")


@dataclass
class Index:
    centers: np.ndarray
    rows: DataFrame  # row_id, x, cell


def probes_for(backend: str, cells: int, k: int, eps: float = 0.0) -> int:
    """Cells to probe: a greater allowance eps probes fewer; the tree without an allowance probes all, and is exact."""
    if backend not in BACKENDS:
        raise CodedError(INPUT, "unknown approximate backend", backend=backend, known=BACKENDS)
    if backend == "scipy_ckdtree" and eps == 0:
        return cells
    share = {"scipy_ckdtree": 0.5, "faiss": 0.3, "pynndescent": 0.3, "scann": 0.25}[backend]
    return max(1, min(cells, math.ceil(share * cells / (1 + eps)) + math.ceil(k / BLOCK_ROWS)))


def _cells(x: np.ndarray, centers: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest centers of each row, ties to the smaller number."""
    off = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)
    return np.argsort(off, axis=1, kind="stable")[:, :count]


def build(library: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 0) -> Index:
    """library: row_id, x (without nulls). cells: by default the square root of the rows."""
    rows = library.select("row_id", F.col("x").cast("array<double>").alias("x"))
    n = rows.count()
    cells = max(1, min(n, cells or math.isqrt(max(n, 1))))
    fitted = rows.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(sample)
    if not n:
        return Index(np.zeros((1, 0)), rows.withColumn("cell", F.lit(0)))
    model = KMeans(k=cells, seed=seed, maxIter=20, featuresCol="v").fit(fitted.select(array_to_vector("x").alias("v")))
    centers = np.array([c.tolist() for c in model.clusterCenters()])
    return Index(centers, appended(rows, "cell", "int", lambda b: pa.array(_cells(matrix(column(b, "x")), centers, 1)[:, 0], pa.int32())))


def save(index: Index, path: str) -> None:
    index.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    write_text(index.rows.sparkSession, f"{path}/centers.json", json.dumps(index.centers.tolist()))


def load(spark: SparkSession, path: str) -> Index:
    return Index(np.array(json.loads(read_text(spark, f"{path}/centers.json"))), spark.read.parquet(f"{path}/rows"))


def knn(queries: DataFrame, index: Index, k: int, probes: int) -> DataFrame:
    """(query_id, rank, row_id, distance) among the rows of the probed cells. queries: query_id, q without nulls."""
    centers, count = index.centers, max(1, min(probes, len(index.centers)))
    given = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    near = appended(given, "cells", "array<int>", lambda b: lists(_cells(matrix(column(b, "q")), centers, count), pa.int32(), False))
    sizes = index.rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # a row a cell
    asked = near.select("query_id", "q", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    parts = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    held = index.rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("distance", pa.float64())])

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        q, x, rows = matrix(a.column("q")), matrix(b.column("x")), b.column("row_id").to_numpy()
        at, far = kernels.nearest(q, np.ones(q.shape, bool), x, rows, k)
        who, slot = np.nonzero(np.isfinite(far))
        return pa.table([a.column("query_id").combine_chunks().take(pa.array(who)), pa.array(rows[at[who, slot]]), pa.array(far[who, slot])], schema=schema)

    keys = ["cell", "block", "part"]
    found = asked.groupBy(*keys).cogroup(held.select(*keys, "row_id", "x").groupBy(*keys)).applyInArrow(pair, "query_id long, row_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "distance")
