"""Combining neighbours given as rows: weights, reconstruction, policy, blending and projection.

The mapping itself (mapping/retrieval.py) keeps a query's neighbours as arrays; these steps serve neighbours as rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..mapping import kernels, retrieval

EXACT = kernels.EXACT


def mean_weights(neighbors: DataFrame) -> DataFrame:
    return neighbors.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("query_id")).cast("double"))


def distance_weights(neighbors: DataFrame) -> DataFrame:
    """Inverse distance; exact hits share all weight equally."""
    w = Window.partitionBy("query_id")
    hit = (F.col("distance") <= EXACT).cast("double")
    raw = F.when(F.max(hit).over(w) > 0, hit).otherwise(1 / F.col("distance"))
    return neighbors.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(w)).drop("raw")


def simplex_weights(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Simplex weights of one query's neighbours; x: neighbours by bands."""
    far = np.sqrt(((x - q) ** 2).mean(axis=1))[None]
    return kernels.weights("simplex_mixture", x[None].astype(float), far, q[None].astype(float), np.ones((1, len(q)), bool))[0]


def project_simplex(v: np.ndarray) -> np.ndarray:
    return kernels.onto_simplex(v[None])[0]


def combined(weighted: DataFrame, library: DataFrame) -> DataFrame:
    """(query_id, values): weighted sum of the neighbours' vectors as an array, runs of a query summed batch by batch."""
    rows = weighted.join(library.select("row_id", F.col("x").cast("array<double>").alias("y")), "row_id")
    placed = rows.select(F.col("query_id").alias("sample_index"), F.col("weight").alias("w"), "y").repartition("sample_index").sortWithinPartitions("sample_index")
    made = placed.mapInArrow(retrieval._summed, "sample_index long, made array<double>")
    return made.select(F.col("sample_index").alias("query_id"), F.col("made").alias("values"))


def reconstruct(weighted: DataFrame, library: DataFrame) -> DataFrame:
    """The same by position: (query_id, pos, value)."""
    rows = combined(weighted, library).select("query_id", F.posexplode("values").alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def policy(rows: DataFrame, col: str = "confidence") -> DataFrame:
    """rows with level and policy of a score; none is unavailable and rejected."""
    c = F.col(col)
    return rows.withColumn("level", F.when(c >= 0.85, "high").when(c >= 0.6, "medium").when(c.isNull(), "unavailable").otherwise("low")).withColumn(
        "policy", F.when(c >= 0.85, "accept").when(c >= 0.6, "manual_review").otherwise("reject")
    )


def weighted_average(values: Column, weights: list[float]) -> Column:
    """Response-weighted average of an array, over the support of the weights only."""
    support = [k for k, w in enumerate(weights) if w > 0]
    if not support:
        raise ValueError("invalid_sensor_schema: no positive response")
    lo, hi = support[0], support[-1] + 1
    w = F.array(*[F.lit(float(x)) for x in weights[lo:hi]])
    total = F.aggregate(F.zip_with(F.slice(values, lo + 1, hi - lo), w, lambda v, r: v.cast("double") * r), F.lit(0.0), lambda a, b: a + b)
    return total / F.lit(float(sum(weights[lo:hi])))


def blend(left: Column, right: Column, position: Column, start: float, end: float) -> Column:
    """Left below start, right above end, a linear ramp between."""
    w = (F.lit(end) - position) / F.lit(end - start)
    return F.when(position < start, left).when(position > end, right).otherwise(w * left + (1 - w) * right)


def blended(vnir: Column, swir: Column, grid) -> Column:
    """Both segments' arrays as one on the whole grid, with the ramp on the overlap."""
    (lo, hi), v0, s0 = grid.blend, grid.vnir[0], grid.swir[0]
    n = hi - lo + 1
    head = F.slice(vnir, 1, lo - v0)
    pairs = F.arrays_zip(F.slice(vnir, lo - v0 + 1, n).alias("v"), F.slice(swir, lo - s0 + 1, n).alias("s"))
    ramp = F.transform(pairs, lambda p, i: (F.lit(n - 1) - i) / F.lit(float(n - 1)) * p["v"] + i / F.lit(float(n - 1)) * p["s"])
    return F.concat(head, ramp, F.slice(swir, hi - s0 + 2, grid.end - hi))


def linear_apply(values: Column, weights: list[float], bias: float) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(values, w, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda a, b: a + b)
