"""Review of spectra: quality metrics of every one, thresholds by source, a score of strangeness and a flag."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import repairs as R
from .arrays import column, matrix
from .quantiles import median_and_mad, quantiles
from .repairs import ABSORPTION, ABSORPTION_OFF, ABSORPTION_PAD, OUTLIER_WINDOWS

# Windows, weights and limits.
TAIL_FIT, TAIL_END, TAIL_DRIFT = (2350, 2400), (2401, 2500), 0.20
WEIGHTS = {
    "flagged_band_count": 3.0, "max_abs_jump": 2.0, "max_abs_jump_visible": 2.0, "max_abs_jump_tail_2300": 1.5, "max_interp_spike_absorption2": 2.5, "tail_end_drift_2400": 2.5, "max_abs_residual": 2.0, "mean_abs_residual": 1.5,
    "out_of_range_band_count": 4.0,
}
BLANK_IS_ZERO = ("max_abs_jump_tail_2300", "max_interp_spike_absorption2", "tail_end_drift_2400")
LARGEST_Z = 50.0
LARGE, SMALL_SHARE, LARGE_SHARE, LEAST_RESIDUAL, LEAST_BANDS = 1000, 0.995, 0.999, 0.10, 250.0
REALS = ("max_abs_jump", "max_abs_jump_visible", "max_abs_jump_tail_2300", "max_abs_residual", "max_interp_spike_absorption2", "tail_end_drift_2400", "mean_abs_residual", "min_reflectance", "max_reflectance")
COUNTS = ("flagged_band_count", "out_of_range_band_count", "valid_band_count")


def _largest(v: np.ndarray) -> np.ndarray:
    top = np.where(np.isfinite(v), v, -np.inf).max(axis=1, initial=-np.inf)
    return np.where(np.isneginf(top), np.nan, top)


def measured(y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of every row of a matrix."""
    mask, z = R.flagged(y, x, OUTLIER_WINDOWS, filled=True)
    step, off = np.abs(np.diff(y, axis=1)), np.where(np.isfinite(y), np.abs(y - z), np.nan)
    at = np.flatnonzero(R.inside(x, ABSORPTION))
    at = at[(at >= ABSORPTION_PAD) & (at < y.shape[1] - ABSORPTION_PAD)]
    line = (y[:, at - ABSORPTION_PAD] + y[:, at + ABSORPTION_PAD]) / 2
    known = np.isfinite(off)
    with np.errstate(invalid="ignore"):
        out = (y < R.BOUNDS[0]) | (y > R.BOUNDS[1])
        mean = np.where(known, off, 0.0).sum(axis=1) / np.where(known.any(axis=1), known.sum(axis=1), np.nan)
    return {
        "flagged_band_count": mask.sum(axis=1), "max_abs_jump": _largest(step), "max_abs_jump_visible": _largest(step[:, (x[:-1] >= 400) & (x[:-1] < 700)]), "max_abs_jump_tail_2300": _largest(step[:, x[:-1] >= 2300]),
        "max_abs_residual": _largest(off), "max_interp_spike_absorption2": _largest(np.abs(y[:, at] - line)), "tail_end_drift_2400": _tail(y, x), "mean_abs_residual": mean,
        "min_reflectance": -_largest(-y), "max_reflectance": _largest(y), "out_of_range_band_count": out.sum(axis=1), "valid_band_count": np.isfinite(y).sum(axis=1),
    }


def _tail(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Largest distance of the tail's end from the line through the values before it, all rows' lines at once."""
    fit, end = R.inside(x, TAIL_FIT), R.inside(x, TAIL_END)
    v, xs = y[:, fit], x[fit]
    ok = np.isfinite(v)
    n = ok.sum(axis=1)
    out = np.full(len(y), np.nan)
    good = (n >= 2) & np.isfinite(y[:, end]).any(axis=1) if fit.any() and end.any() else np.zeros(len(y), bool)
    if good.any():
        w, v = ok[good].astype(float), np.where(ok[good], v[good], 0.0)
        mx, my = (w * xs).sum(axis=1) / n[good], v.sum(axis=1) / n[good]
        dx = (xs - mx[:, None]) * w
        slope = (dx * v).sum(axis=1) / (dx * dx).sum(axis=1)
        out[good] = _largest(np.abs(y[good][:, end] - (my[:, None] + slope[:, None] * (x[end] - mx[:, None]))))
    return out


def metrics(df: DataFrame, start: int = 400, values: str = "values") -> DataFrame:
    """df without the array, with the metrics as columns."""
    kept = [f for f in df.schema.fields if f.name != values]
    schema = StructType([*kept, *[StructField(n, LongType()) for n in COUNTS], *[StructField(n, DoubleType()) for n in REALS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                y = matrix(column(part, values))
                found = measured(y, np.arange(start, start + y.shape[1]).astype(float))
                more = [pa.array(found[n], pa.int64()) for n in COUNTS] + [pa.array(found[n], pa.float64(), from_pandas=True) for n in REALS]
                yield pa.RecordBatch.from_arrays([*[column(part, f.name) for f in kept], *more], names=schema.names)

    return df.mapInArrow(run, schema)


def source_thresholds(rows: DataFrame) -> DataFrame:
    """source_id, source_residual_threshold, source_flagged_band_threshold: a high quantile of the source, or a floor."""

    def limit(value: str, floor: float, name: str) -> DataFrame:
        q = quantiles(rows, ["source_id"], value, [SMALL_SHARE, LARGE_SHARE])
        picked = F.when(F.col("n") >= LARGE, F.col("q")[1]).otherwise(F.col("q")[0])
        return q.select("source_id", F.greatest(F.lit(floor), picked).alias(name))

    a = limit("max_abs_residual", LEAST_RESIDUAL, "source_residual_threshold")
    b = limit("flagged_band_count", LEAST_BANDS, "source_flagged_band_threshold")
    every = rows.select("source_id").distinct()
    return every.join(a, "source_id", "left").join(b, "source_id", "left").na.fill({"source_residual_threshold": LEAST_RESIDUAL, "source_flagged_band_threshold": LEAST_BANDS})


def with_thresholds(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(source_thresholds(rows)), "source_id")


def suspicious() -> Column:
    """The flag from metrics and thresholds."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    emit, santa = F.col("source_id").startswith("emit_"), F.col("source_id") == "santa_barbara_urban_reflectance"
    return (
        (F.col("out_of_range_band_count") > 0) | (c("max_abs_jump") >= 0.15) | (c("max_abs_jump_visible") >= 0.05) | (c("max_abs_jump_tail_2300") >= 0.05)
        | (emit & (c("max_interp_spike_absorption2") >= ABSORPTION_OFF)) | (santa & (c("tail_end_drift_2400") >= TAIL_DRIFT))
        | (c("max_abs_residual") >= F.col("source_residual_threshold")) | ((F.col("flagged_band_count") >= F.col("source_flagged_band_threshold")) & (c("max_abs_residual") >= 0.05))
    )


def robust_z(value: Column, median: float, mad: float) -> Column:
    """Distance above the median in robust deviations, 0 to 50; 0 where the value is missing."""
    return F.coalesce(F.least(F.lit(LARGEST_Z), F.greatest(F.lit(0.0), (value - F.lit(median)) / F.lit(max(mad, 1e-9)))), F.lit(0.0))


def scored(rows: DataFrame) -> DataFrame:
    """Metrics with thresholds, strange_score (weighted robust z) and is_suspicious."""
    out, score = with_thresholds(rows), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        value = F.coalesce(F.col(name), F.lit(0.0)) if name in BLANK_IS_ZERO else F.col(name).cast("double")
        found = median_and_mad(rows.withColumn("_v", value), [], "_v").first()  # one row
        if found is not None:
            score = score + weight * robust_z(value, found["median"], found["mad"])
    return out.withColumn("strange_score", score).withColumn("is_suspicious", suspicious())


def strangest(scores: DataFrame, n: int, keys: Sequence[str] = ("source_id", "spectrum_id")) -> DataFrame:
    """The n rows of highest score, suspicious ones first."""
    return scores.orderBy(F.desc("is_suspicious"), F.desc("strange_score"), *keys).limit(n)


def strangest_by(scores: DataFrame, n: int, by: str = "source_id", keys: Sequence[str] = ("spectrum_id",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("is_suspicious"), F.desc("strange_score"), *keys))
    return scores.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

