"""Kernels on one series (a spectrum) in numpy, and the scalar functions on cells as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .whittaker import TUKEY, smooth


def fill_gaps(y: np.ndarray, max_missing: int = 8, max_run: int = 8) -> np.ndarray | None:
    """Linear inside, held at the edges; None with under two values or too many or too long internal gaps."""
    at = np.flatnonzero(np.isfinite(y))
    if len(at) < 2:
        return None
    inner = np.diff(at) - 1
    if inner.sum() > max_missing or inner.max() > max_run:
        return None
    return np.interp(np.arange(len(y)), at, y[at])


def fill_linear(y: np.ndarray) -> np.ndarray:
    """Missing places on the line between their neighbours, edges held; as it is with under two values."""
    at = np.flatnonzero(np.isfinite(y))
    return np.interp(np.arange(len(y)), at, y[at]) if len(at) >= 2 else np.array(y, float)


def local_deviation(y: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Interpolation between the values `pad` places away, and the distance from it; NaN where a value is missing."""
    line = np.full(len(y), np.nan)
    if len(y) > 2 * pad:
        line[pad:-pad] = (y[: -2 * pad] + y[2 * pad :]) / 2
    return line, np.abs(y - line)


def flatten_spikes(y: np.ndarray, lo: int, hi: int, pad: int, threshold: float) -> np.ndarray:
    """Replace the largest local deviation of positions lo..hi while it reaches the threshold, at most thrice a position."""
    y = np.array(y, float)
    for _ in range(3 * max(hi - lo + 1, 0)):
        line, off = local_deviation(y, pad)
        off = np.where(np.isfinite(off), off, 0)[lo : hi + 1]
        if not len(off) or off.max() < threshold or off.max() == 0:
            break
        k = lo + int(off.argmax())
        y[k] = line[k]
    return y


def extend_tail(y: np.ndarray, start: int, fit: int, threshold: float) -> np.ndarray:
    """Continue the line through the `fit` values before `start` where the tail drifts from it by the threshold or more."""
    y = np.array(y, float)
    x = np.arange(len(y))
    use = np.flatnonzero(np.isfinite(y[:start]))[-fit:]
    if len(use) < 2 or start >= len(y):
        return y
    line = np.polyval(np.polyfit(x[use], y[use], 1), x[start:])
    off = np.abs(y[start:] - line)
    if np.isfinite(off).any() and np.nanmax(off) >= threshold:
        y[start:] = line
    return y


def whittaker(y: np.ndarray, strength: float = 100.0, rounds: int = 8, cut: float = TUKEY) -> tuple[np.ndarray, np.ndarray]:
    """Smooth and weights of one series, see whittaker.py."""
    z, w = smooth(np.asarray(y, float)[None], strength, rounds, cut)
    return z[0], w[0]


def replace_outliers(y: np.ndarray, threshold: float, weight: float = 0.1, strength: float = 100.0) -> np.ndarray:
    """Values of low robust weight that are further than the threshold from the smooth become the smooth; y: a series, or a matrix of them."""
    rows = np.atleast_2d(np.asarray(y, float))
    z, w = smooth(rows, strength)
    with np.errstate(invalid="ignore"):
        out = np.where((w < weight) & (np.abs(rows - z) > threshold), z, rows)
    return out if np.ndim(y) == 2 else out[0]


def parse_number(c: Column) -> Column:
    """Number of a text cell: a trailing % goes, a decimal comma counts where there is no dot; null where none."""
    s = F.regexp_replace(F.trim(c), "\\s*%$", "")
    s = F.when(s.contains("."), s).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return F.when(F.lower(s).isin("na", "nan", "n/a", "null", "none", ""), None).otherwise(s).try_cast("double")


def parse_flag(c: Column) -> Column:
    """Blank is true; null for what is neither a yes nor a no."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("", "1", "true", "t", "yes", "y"), True).when(s.isin("0", "false", "f", "no", "n"), False)


def to_nanometres(value: Column, unit: Column, largest: Column) -> Column:
    """Wavelength in nm by its unit, or where that says nothing by the largest value of its series."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    factor = (
        F.when(u.contains("micro") | u.isin("um", "µm"), 1e3).when(u.contains("nano") | (u == "nm"), 1.0).when(u.isin("m", "meter", "metre", "meters", "metres"), 1e9)
        .when(largest <= 1e-5, 1e9).when(largest <= 10, 1e3).otherwise(1.0)
    )
    return value * factor
