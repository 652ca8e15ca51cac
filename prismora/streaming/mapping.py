"""Mapping of queries that arrive in chunks: long rows to one row a sample, and a stream of chunks to reconstructions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import estimators
from ..operators.knn import knn
from .chunks import chunk_rows

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Unset, it is an error on a cluster; on local[n] a temporary folder is made."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="prismora-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def samples(rows: DataFrame, bands: list[str]) -> DataFrame:
    """(sample_id, q, valid) from long rows sample_id, band_id, reflectance[, valid], interleaved in any way.

    A band without a row, or with a null value, is invalid; a band given twice is an error; other bands are ignored.
    """
    good = F.col("reflectance").isNotNull()
    if "valid" in rows.columns:
        good &= F.coalesce(F.col("valid"), F.lit(True))
    marks = [F.col("band_id") == b for b in bands]
    found = rows.groupBy("sample_id").agg(
        *[F.count_if(m).alias(f"n{k}") for k, m in enumerate(marks)],
        *[F.max(F.when(m & good, F.col("reflectance").cast("double"))).alias(f"v{k}") for k, m in enumerate(marks)],
    )
    value = [F.when(F.col(f"n{k}") > 1, F.raise_error(F.lit(f"duplicate_band: {b}")).cast("double")).otherwise(F.col(f"v{k}")) for k, b in enumerate(bands)]
    return found.select("sample_id", F.array(*value).alias("q")).withColumn("valid", F.transform("q", lambda v: v.isNotNull()))


def map_stream(queries: DataFrame, library: DataFrame, out: str, checkpoint: str, k: int, weights: Callable[[DataFrame], DataFrame] = estimators.mean_weights) -> StreamingQuery:
    """Start a stream that maps each chunk of queries (query_id, q, valid) and ends when all that is there is read.

    The result, (query_id, pos, value), is Parquet in `out`, a folder a chunk: a chunk that is run again after a failure
    replaces its own folder, so no row comes twice.
    """

    width = len((library.select("x").first() or [[0]])[0])

    def chunk(rows: DataFrame, number: int) -> None:
        rows.sparkSession.conf.set(BATCH_ROWS, str(min(10_000, chunk_rows(width, width))))  # rows that a task holds at a time
        found = estimators.reconstruct(weights(knn(rows, library, k)), library)
        found.write.mode("overwrite").parquet(f"{out}/chunk={number}")

    return queries.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_samples(rows: DataFrame, bands: list[str], wait: str | None = None) -> DataFrame:
    """A stream of long rows (sample_id, band_id, reflectance[, valid]) as a stream of (sample_id, q, valid).

    A sample is given out when it has all its bands, whatever other rows stand between; with `wait` (milliseconds) also
    when nothing came for so long, its missing bands invalid. A band given twice while its sample waits is an error;
    other bands and null ids are ignored.
    """
    place = {b: k for k, b in enumerate(bands)}
    flag = F.coalesce(F.col("valid"), F.lit(True)) if "valid" in rows.columns else F.lit(True)
    given = rows.where(F.col("sample_id").isNotNull() & F.col("band_id").isin(bands)).select(F.col("sample_id").cast("string").alias("sample_id"), "band_id", F.when(flag, F.col("reflectance").cast("double")).alias("reflectance"))

    def done(name: str, q: list) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": [name], "q": [q], "valid": [[v is not None for v in q]]})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, seen = map(list, state.get) if state.exists else ([None] * len(bands), [False] * len(bands))
        if state.hasTimedOut:
            state.remove()
            yield done(key[0], q)
            return
        for part in parts:
            for band, value in zip(part["band_id"], part["reflectance"]):
                k = place[band]
                if seen[k]:
                    raise ValueError(f"duplicate_band: {key[0]} {band}")
                seen[k], q[k] = True, None if pd.isna(value) else float(value)
        if all(seen):
            if state.exists:
                state.remove()
            yield done(key[0], q)
        else:
            state.update((q, seen))
            if wait:
                state.setTimeoutDuration(int(wait))

    limit = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return given.groupBy("sample_id").applyInPandasWithState(step, "sample_id string, q array<double>, valid array<boolean>", "q array<double>, seen array<boolean>", "append", limit)
