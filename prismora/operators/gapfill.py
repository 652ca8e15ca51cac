"""Gaps and noisy bands filled from principal components of a land-cover class.

A model is fitted on a bounded sample of whole spectra of a class, screened for noise; a spectrum's missing places are
then predicted from those it has, by ridge regression on the components, and held near the range of the training.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.repairs import Span, inside
from .arrays import column, lists, matrix
from .curation import sampled

# Bands, bounds and sizes.
DEEP_BANDS = {"water_abs_1400": (1330, 1455), "water_abs_1900": (1770, 1985)}
BLUE_BAND, BLUE_MODEL, BLUE_FROM = {"blue_edge_400_500": (400, 500)}, (400, 900), (501, 900)
TRAIN_POINTS, TRAIN_RANGE = 2090, (400.0, 2490.0)
BLUE_POINTS, BLUE_RANGE = 480, (400.0, 900.0)
SAMPLE = 5000
LEAST, MOST, VARIANCE, RIDGE, MARGIN = 3, 12, 0.995, 1e-6, 0.05


@dataclass
class Model:
    x: np.ndarray
    mean: np.ndarray
    components: np.ndarray  # by columns
    low: np.ndarray
    high: np.ndarray
    noise: dict[str, float] = field(default_factory=dict)
    rows: int = 0
    noisy: int = 0
    explained: float = 0.0


def band_noise(y: np.ndarray) -> float:
    """Median absolute second difference; infinite with a gap, 0 with under five values."""
    if not np.isfinite(y).all():
        return float("inf")
    return float(np.median(np.abs(np.diff(y, 2)))) if len(y) >= 5 else 0.0


def fit(values: np.ndarray, x: np.ndarray, bands: Mapping[str, Span]) -> Model | None:
    """Components for 99.5 % of the variance, 3 to 12, of whole rows that are not noisy in the bands."""
    rows = values[np.isfinite(values).all(axis=1)]
    if not len(rows):
        return None
    keep, limits = np.ones(len(rows), bool), {}
    for name, span in bands.items():
        m = np.array([band_noise(r[inside(x, span)]) for r in rows])
        mid = np.median(m)
        limits[name] = float(max(np.quantile(m, 0.99), mid + 6 * 1.4826 * np.median(np.abs(m - mid)), 1e-6))
        keep &= m <= limits[name]
    clean = rows[keep] if keep.sum() >= 8 else rows
    mean = clean.mean(axis=0)
    _, s, vt = np.linalg.svd(clean - mean, full_matrices=False)
    share = s**2 / (s**2).sum() if (s**2).sum() > 0 else np.zeros(len(s))
    n = max(1, max(LEAST, min(MOST, int(np.searchsorted(np.cumsum(share), VARIANCE) + 1), len(clean) - 1)))
    return Model(x, mean, vt[:n].T, clean.min(axis=0), clean.max(axis=0), limits, len(clean), len(rows) - len(clean), float(share[:n].sum()))


def predicted(y: np.ndarray, m: Model, replace: np.ndarray, observed: np.ndarray) -> np.ndarray | None:
    """y (on the model's places) with the replaced places predicted from observed ones; None with too few of these."""
    use = observed & np.isfinite(y) & ~replace
    if use.sum() < max(8, m.components.shape[1]):
        return None
    d = m.components[use]
    c = np.linalg.solve(d.T @ d + RIDGE * np.eye(d.shape[1]), d.T @ (y[use] - m.mean[use]))
    made = np.clip(m.mean + m.components @ c, m.low - MARGIN, m.high + MARGIN)
    return np.where(replace, made, y)


def models(df: DataFrame, group: str, span: Span, bands: Mapping[str, Span], points: int, native: Span, start: int = 400, sample: int = SAMPLE, seed: int = 42) -> dict[str, Model]:
    """A model of each class, from at most `sample` of its rows; df: group, source_id, spectrum_id, normalized_points,
    native_min_nm, native_max_nm, values. One class' sample is fitted in one task; only models reach the driver."""
    good = df.where(F.col(group).isNotNull() & (F.col("normalized_points") >= points) & (F.col("native_min_nm") <= native[0]) & (F.col("native_max_nm") >= native[1]))
    at = int(span[0]) - start
    part = F.slice("values", at + 1, int(span[1] - span[0]) + 1)
    rows = sampled(good.select(group, "source_id", "spectrum_id", part.alias("values")), [group], sample, ["source_id", "spectrum_id"], seed)
    x = np.arange(span[0], span[1] + 1).astype(float)
    fields = "group string, mean array<double>, components array<array<double>>, low array<double>, high array<double>, noise map<string,double>, rows long, noisy long, explained double"

    def one(d: pd.DataFrame) -> pd.DataFrame:
        names = [f.split()[0] for f in fields.split(", ")]
        m = fit(np.array([[np.nan if v is None else v for v in r] for r in d["values"]], float), x, bands)
        row = [] if m is None else [(str(d[group].iloc[0]), m.mean.tolist(), m.components.T.tolist(), m.low.tolist(), m.high.tolist(), m.noise, m.rows, m.noisy, m.explained)]
        return pd.DataFrame(row, columns=names)

    return {r["group"]: Model(x, np.array(r["mean"]), np.array(r["components"]).T, np.array(r["low"]), np.array(r["high"]), dict(r["noise"]), r["rows"], r["noisy"], r["explained"]) for r in rows.groupBy(group).applyInPandas(one, fields).collect()}


def filled(df: DataFrame, group: str, full: Mapping[str, Model], blue: Mapping[str, Model], start: int = 400) -> DataFrame:
    """df with filled values and gap_points, blue_points, deep_points, noisy_bands, model_used."""
    kept = [f for f in df.schema.fields if f.name != "values"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", values array<double>, gap_points int, blue_points int, deep_points int, noisy_bands string, model_used string"
    blue_span = next(iter(BLUE_BAND.values()))

    def one(y: np.ndarray, x: np.ndarray, name: str) -> tuple:
        gap, out, gaps, deep, edge, noisy, used = ~np.isfinite(y), y, 0, 0, 0, [], []
        m = full.get(name)
        replace = gap & ~inside(x, blue_span)
        for band, span in DEEP_BANDS.items():
            at = inside(x, span)
            if not np.isfinite(y[at]).all():
                replace |= at
            elif m and band_noise(y[at]) > m.noise.get(band, np.inf):
                replace |= at
                noisy.append(band)
        if m and replace.any():
            at = np.isin(x, m.x)
            new = predicted(out[at], m, replace[at], np.ones(at.sum(), bool))
            if new is not None:
                out = out.copy()
                out[at] = new
                own = int((gap & replace).sum())
                gaps, deep, used = gaps + own, max(0, int(replace.sum()) - own), [f"{name}_full"]
            else:
                noisy = []
        b = blue.get(name)
        at = inside(x, blue_span)
        replace = at & gap
        band = next(iter(BLUE_BAND))
        rough = b is not None and np.isfinite(n := band_noise(y[at])) and n > b.noise.get(band, np.inf)
        if rough:
            replace = at
        if b and replace.any():
            own_at = np.isin(x, b.x)
            new = predicted(out[own_at], b, replace[own_at], inside(x[own_at], BLUE_FROM))
            if new is not None:
                out = out.copy()
                out[own_at] = new
                own = int((gap & replace).sum())
                gaps, edge = gaps + own, max(0, int(replace.sum()) - own)
                used.append(f"{name}_blue")
                noisy += [band] if rough else []
        return out, gaps, edge, deep, ",".join(sorted(set(noisy))), "+".join(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = matrix(column(batch, "values"))
                x = np.arange(start, start + y.shape[1]).astype(float)
                done = [one(r, x, g or "") for r, g in zip(y, column(batch, group).to_pylist())]
                cols = list(zip(*done))
                yield pa.RecordBatch.from_arrays(
                    [*[column(batch, f.name) for f in kept], lists(np.array(cols[0])), *[pa.array(c, pa.int32()) for c in cols[1:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                    names=[*[f.name for f in kept], "values", "gap_points", "blue_points", "deep_points", "noisy_bands", "model_used"],
                )

    return df.mapInArrow(run, schema)
