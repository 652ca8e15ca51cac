"""Robust scaling, principal components from summed products, k-means, cluster outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import median_and_mad, quantiles

FLAT = 1e-6


def robust_scale(long: DataFrame, key: str, value: str) -> DataFrame:
    """key, center (median), scale: 1.4826 * MAD, or the standard deviation where that is flat, or 1."""
    center = median_and_mad(long, [key], value, 0.0).withColumnRenamed("median", "center")
    off = center.join(long.groupBy(key).agg(F.stddev_pop(value).alias("sd")), key)
    return off.select(key, "center", F.when(F.col("mad") > FLAT, F.col("mad")).when(F.col("sd") > FLAT, F.col("sd")).otherwise(1.0).alias("scale"))


def principal_components(df: DataFrame, column: str, count: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(center, components by columns) of an array column without nulls; the sign makes the largest loading positive.

    Each batch gives its count, sums and products; they are added by key in Spark, so only one matrix of width^2
    reaches the driver, however many rows there are.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for d in batches:
            if len(d):
                x = np.stack(d[column].to_numpy()).astype(float)
                x = np.c_[np.ones(len(x)), x]
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "side": len(total), "s": total.ravel()})

    sums = df.where(F.col(column).isNotNull()).select(column).mapInPandas(partial, "at long, side long, s double")
    rows = sums.groupBy("at").agg(F.max("side").alias("side"), F.sum("s").alias("s")).orderBy("at").toPandas()
    if rows.empty:
        raise ValueError("no rows to fit components on")
    side = int(rows["side"].iloc[0])
    m = rows["s"].to_numpy().reshape(side, side)
    center = m[0, 1:] / m[0, 0]
    _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(center, center))
    vectors = vectors[:, ::-1][:, :count]
    return center, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def project(df: DataFrame, column: str, center: np.ndarray, components: np.ndarray) -> DataFrame:
    """df with array `scores`, in column expressions."""
    shift = F.zip_with(F.col(column), F.lit(center.tolist()), lambda a, b: a - b)
    one = [F.aggregate(F.zip_with(shift, F.lit(c.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for c in components.T]
    return df.withColumn("scores", F.array(*one))


def kmeans(df: DataFrame, column: str, clusters: int, seed: int) -> DataFrame:
    """df with int cluster and double distance to its center; at most 30 rounds, start by k-means||."""
    vectors = df.withColumn("_vector", array_to_vector(F.col(column)))
    model = KMeans(k=clusters, seed=seed, maxIter=30, featuresCol="_vector", predictionCol="cluster").fit(vectors)
    centers = F.lit([c.tolist() for c in model.clusterCenters()])
    center = F.element_at(centers, F.col("cluster") + 1)
    distance = F.sqrt(F.aggregate(F.zip_with(F.col(column), center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return model.transform(vectors).withColumn("distance", distance).drop("_vector")


def cluster_outliers(df: DataFrame, cluster: str, distance: str) -> DataFrame:
    """df with threshold max(P99, median + 4 * 1.4826 * MAD, 1e-6) of its cluster and score distance / threshold."""
    mid = median_and_mad(df, [cluster], distance, 0.0)
    p99 = quantiles(df, [cluster], distance, [0.99]).select(cluster, F.col("q")[0].alias("p99"))
    limit = mid.join(p99, cluster).select(cluster, F.greatest("p99", F.col("median") + 4 * F.col("mad"), F.lit(1e-6)).alias("threshold"))
    return df.join(limit, cluster).withColumn("score", F.col(distance) / F.col("threshold"))
