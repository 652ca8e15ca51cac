"""Held-out benchmark of retrieval against least squares, and the grid of settings it is run over."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import INPUT, CodedError
from ..operators.arrays import column, matrix
from ..operators.estimators import blended
from .mapper import Mapper

ROWS = 20_000_000  # a permutation of so many rows is made on the driver, at most


def held_out_rows(rows: int, fraction: float, most: int | None) -> int:
    """ceil(rows * fraction), one at least, capped, and never all rows."""
    if rows < 2:
        raise CodedError(INPUT, "two rows are needed at least", rows=rows)
    if not 0 < fraction < 1 or (most is not None and most < 1):
        raise CodedError(INPUT, "the fraction is between 0 and 1, the cap 1 at least", fraction=fraction, cap=most)
    n = max(1, math.ceil(rows * fraction))
    return min(n, most if most is not None else n, rows - 1)


def permuted_split(spark: SparkSession, rows: int, fraction: float, most: int | None = None, seed: int = 0) -> DataFrame:
    """row_index of the test rows: the first of numpy's seeded permutation, as a small table."""
    if rows > ROWS:
        raise CodedError(INPUT, "too many rows for a permutation in one place; use hashed_split", rows=rows)
    test = np.random.default_rng(seed).permutation(rows)[: held_out_rows(rows, fraction, most)]
    return spark.createDataFrame(pa.table({"row_index": pa.array(test, pa.int64())}))


def hashed_split(rows: DataFrame, key: str, fraction: float, most: int | None = None, seed: int = 0) -> DataFrame:
    """The test keys for any number of rows: those of the least MD5 of key and seed, as many as held_out_rows says."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.select(key).orderBy(digest, key).limit(held_out_rows(rows.count(), fraction, most))


def metrics(pairs: DataFrame) -> DataFrame:
    """band, n, rmse, mae, bias of arrays `made` against `truth`; sums a batch, then a band."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                d = matrix(column(b, "made")) - matrix(column(b, "truth"))
                part = np.stack([np.isfinite(d).sum(axis=0), np.nansum(d, axis=0), np.nansum(np.abs(d), axis=0), np.nansum(d * d, axis=0)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names=["band", "n", "s", "a", "q"])

    sums = pairs.select("made", "truth").mapInArrow(partial, "band long, n double, s double, a double, q double").groupBy("band").agg(*[F.sum(c).alias(c) for c in "nsaq"])
    n = F.col("n")
    return sums.select("band", n.cast("long").alias("n"), F.sqrt(F.col("q") / n).alias("rmse"), (F.col("a") / n).alias("mae"), (F.col("s") / n).alias("bias"))


def summary(per_band: DataFrame, *by: str) -> DataFrame:
    return per_band.groupBy(*by).agg(F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.avg(F.abs("bias")).alias("mean_abs_bias"))


def benchmark(mapper: Mapper, source: str, target: str, k: int = 10, fraction: float = 0.2, most: int | None = None, seed: int = 0, estimator: str = "mean", backend: str = "numpy", eps: float = 0.0, test: DataFrame | None = None) -> DataFrame:
    """block, method, band, n, rmse, mae, bias: target bands by retrieval and by least squares, spectra by retrieval.

    test: row_index of the test rows; otherwise permuted_split's. The other rows are the candidates and train the fit.
    """
    lib, spark = mapper.library, mapper.spark
    if test is None:
        test = permuted_split(spark, lib.library.count(), fraction, most, seed)
    train = lib.library.join(F.broadcast(test), "row_index", "left_anti").select("row_index")
    x = lib.simulated(lib.sensor(source)).select("row_index", F.col("x").alias("values")).join(F.broadcast(test), "row_index", "left_semi")
    batch = x.select(F.col("row_index").alias("sample_index"), F.col("row_index").cast("string").alias("sample_id"), "values")
    truth = lib.library.join(F.broadcast(test), "row_index", "left_semi").select(F.col("row_index").alias("sample_index"), *[F.col(s).cast("array<double>").alias(s) for s in ("vnir", "swir")])
    goal = lib.simulated(lib.sensor(target)).join(F.broadcast(test), "row_index", "left_semi").select(F.col("row_index").alias("sample_index"), F.col("x").alias("truth"))
    options = {"k": k, "estimator": estimator, "backend": backend, "eps": eps, "candidates": train}
    parts = []

    def add(block: str, method: str, pairs: DataFrame) -> None:
        parts.append(metrics(pairs).select(F.lit(block).alias("block"), F.lit(method).alias("method"), "*"))

    made = mapper.map_batch(batch, source, "target_sensor", target, **options).select("sample_index", F.col("reflectance").alias("made"))
    add("target_sensor", "retrieval", made.join(goal, "sample_index"))
    fitted = mapper.compile_linear(source, "target_sensor", target, rows=train).apply(batch, "values", "made").select("sample_index", "made")
    add("target_sensor", "regression", fitted.join(goal, "sample_index"))
    found = mapper.retrieved(batch, source, "full_spectrum", **options).select("sample_index", F.col("vnir.values").alias("mv"), F.col("swir.values").alias("ms"))
    both = found.join(truth, "sample_index")
    whole = lambda v, s: blended(F.col(v), F.col(s), lib.grid)
    add("vnir_spectrum", "retrieval", both.select(F.col("mv").alias("made"), F.col("vnir").alias("truth")))
    add("swir_spectrum", "retrieval", both.select(F.col("ms").alias("made"), F.col("swir").alias("truth")))
    add("full_spectrum", "retrieval", both.select(whole("mv", "ms").alias("made"), whole("vnir", "swir").alias("truth")))
    return reduce(DataFrame.unionByName, parts)


def grid(mapper: Mapper, pairs: Iterable[tuple[str, str]], estimators: Iterable[str], backends: Iterable[str], ks: Iterable[int], limits: Mapping[str, float] | None = None, **options) -> DataFrame:
    """Summaries of every setting, their difference from the exact backend's, and `over`, the metrics beyond their limit."""
    rows = [
        summary(benchmark(mapper, s, t, k=k, estimator=e, backend=b, **options), "block", "method").select(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(e).alias("estimator"), F.lit(b).alias("backend"), F.lit(k).alias("k"), "*")
        for s, t in pairs for e in estimators for b in backends for k in ks
    ]
    every = reduce(DataFrame.unionByName, rows)
    keys, names = ["source", "target", "estimator", "k", "block", "method"], ["mean_rmse", "mean_mae", "mean_abs_bias"]
    base = every.where("backend = 'numpy'").select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    out = every.join(base, keys, "left")
    for n in names:
        out = out.withColumn(f"{n}_delta", F.col(n) - F.col(f"_{n}")).drop(f"_{n}")
    over = [F.when(F.col(n) > F.lit(float(v)), F.lit(n)) for n, v in (limits or {}).items()]
    return out.withColumn("over", F.array_compact(F.array(*over)) if over else F.array().cast("array<string>"))
