"""Repairs of spectra by source: which rules are tried on which rows, and what each changed. One Arrow batch at a time.

A stage is a list of (rows it is for, name, kernel). Its result has the repaired `values` and `repairs`: an array of
name, first and last changed wavelength, number of changed places, mean and largest change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import repairs as R
from ..functions.repairs import Bridge, OutlierWindow, SmoothWindow
from .arrays import column, lists, matrix

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray | None]
REPAIRS = "array<struct<name:string,start_nm:double,end_nm:double,changed:int,mean_abs_delta:double,max_abs_delta:double>>"
_REPAIRS = pa.list_(pa.struct([("name", pa.string()), ("start_nm", pa.float64()), ("end_nm", pa.float64()), ("changed", pa.int32()), ("mean_abs_delta", pa.float64()), ("max_abs_delta", pa.float64())]))

# Windows and thresholds of the sources.
OUTLIER_WINDOWS = [
    OutlierWindow(400, 550, 100.0, 0.005), OutlierWindow(550, 760, 50.0, 0.010), OutlierWindow(760, 1350, 100.0, 0.010), OutlierWindow(1350, 1450, 50.0, 0.010),
    OutlierWindow(1450, 1800, 100.0, 0.010), OutlierWindow(1800, 2000, 50.0, 0.010), OutlierWindow(2000, 2450, 100.0, 0.010),
]
ABSORPTION = (1850, 1950)
ABSORPTION_PAD, ABSORPTION_OFF = 3, 0.05
SHOULDER = Bridge("emit_second_absorption_shoulder_interp", (1820, 1935), (1805, 1815), (1935, 1945), falling=True, judged=(1820, 1930), rise=0.08)
DEEP = [
    Bridge("ghisacasia_deep_absorption_1400_interp", (1330, 1455), (1280, 1320), (1460, 1500), rise=0.015),
    Bridge("ghisacasia_deep_absorption_1900_interp", (1770, 1985), (1720, 1760), (1990, 2030), rise=0.015),
]
WATER = [
    Bridge("water_absorption_1400", (1380, 1425), (1320, 1360), (1455, 1495), straight=False, clip=None, rise=0.12, steps=0.04, every=True, whole=True),
    Bridge("water_absorption_1900", (1875, 1935), (1760, 1800), (1995, 2035), straight=False, clip=None, rise=0.15, steps=0.05, every=True, whole=True),
]
POINT_SPIKES = [("point_spike_1400", (1368, 1425), 8, 0.08, 0.05, 120), ("point_spike_1900", (1800, 1935), 8, 0.08, 0.05, 160)]
WIDE_BOUNDS = (-0.05, 1.2)
UNDERSTORY = [
    Bridge("understory_absorption_1400_interp", (1355, 1435), (1320, 1350), (1455, 1495), 40, "median", straight=False, clip=WIDE_BOUNDS, off=0.08, steps=0.05, range_counts=WIDE_BOUNDS, whole=True),
    Bridge("understory_absorption_1900_interp", (1820, 2025), (1760, 1800), (2060, 2100), 65, "median", straight=False, clip=WIDE_BOUNDS, off=0.10, steps=0.08, range_counts=WIDE_BOUNDS, whole=True),
]
SMOOTHED = {
    "hyspiri_ground_targets": "1400 1900 2300", "ghisacasia_v001": "1400 1900 2300", "ngee_arctic_2018": "1400 1900 2300", "santa_barbara_urban_reflectance": "2300",
}
SMOOTH_WINDOWS = {
    "1400": SmoothWindow("deep_absorption_1400", (1330, 1455), (1280, 1500), 120.0), "1900": SmoothWindow("deep_absorption_1900", (1770, 1985), (1720, 2030), 120.0),
    "2300": SmoothWindow("water_absorption_2300_plus", (2300, 2500), (2240, 2500), 80.0),
}


def _shoulders(name: str, replace: R.Span, left: R.Span, right: R.Span, half: float) -> Bridge:
    """A window between shoulders of usable values, repaired where values leave the bounds or step by over 0.03."""
    return Bridge(name, replace, left, right, half, "median", 4, True, False, steps=0.03, range_counts=R.BOUNDS, whole=True)


@dataclass(frozen=True)
class Rule:
    name: str
    source: str  # of the rows it is for; a name that ends in * is a prefix, "" is every source
    kernel: Kernel
    group: str = ""  # land cover of the rows it is for


def bridge(source: str, b: Bridge, group: str = "") -> Rule:
    return Rule(b.name, source, partial(R.bridged, r=b), group)


def _bounded(kernel: Kernel) -> Kernel:
    def run(y: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        out = kernel(y, x)
        return None if out is None else np.clip(out, *R.CLIP)

    return run


ARTIFACTS = [
    Rule("emit_second_absorption_interp", "emit_*", partial(R.spikes, span=ABSORPTION, pad=ABSORPTION_PAD, threshold=ABSORPTION_OFF)), bridge("emit_*", SHOULDER),
    Rule("santa_tail_linear_extrapolation", "santa_barbara_urban_reflectance", partial(R.tail_line, fit=(2350, 2400), tail=(2401, 2500), half=50, drift=0.20)),
]
DEEP_WINDOWS = [*[bridge("ghisacasia_v001", b) for b in DEEP], Rule("ghisacasia_tail_linear_extrapolation", "ghisacasia_v001", partial(R.tail_line, fit=(2240, 2390), tail=(2400, 2500), half=50, drift=0.05))]
VEGETATION_WATER = [
    *[bridge("", b, "vegetation") for b in WATER],
    *[Rule(n, "understory_estonia_czech", partial(R.spikes, span=s, pad=p, threshold=t, steps=j, most=m), "vegetation") for n, s, p, t, j, m in POINT_SPIKES],
]
VEGETATION_OUTLIERS = [
    *[bridge("understory_estonia_czech", b) for b in UNDERSTORY],
    Rule("understory_tail_linear_extrapolation", "understory_estonia_czech", partial(R.tail_ramp, fit=(2300, 2375), blend=(2350, 2400), tail=(2401, 2500), bounds=WIDE_BOUNDS, steps=0.08, off=0.08)),
]
BLUE_EDGE = [
    Rule("blue_edge_bridge", "ghisaconus_v001", partial(R.edge_bridge, start=430, end=436, anchor=437), "vegetation"),
    Rule("blue_edge_backfill", "", R.backfilled, "urban"),
]
GUARDED = [Rule(SMOOTH_WINDOWS[k].name, s, partial(R.guarded, r=SMOOTH_WINDOWS[k])) for s, ks in SMOOTHED.items() for k in ks.split()]
REMAINING = [
    bridge("understory_estonia_czech", _shoulders("understory_1400_window_interp", (1368, 1425), (1330, 1360), (1435, 1465), 15)),
    bridge("understory_estonia_czech", _shoulders("understory_1900_window_interp", (1830, 2025), (1790, 1820), (2030, 2060), 15)),
    Rule("understory_tail_2340_2500_constrained", "understory_estonia_czech", R.constrained_tail),
    Rule("understory_out_of_range_segment_interp", "understory_estonia_czech", partial(R.segments, low=1350)),
    Rule("understory_full_robust_outlier_band_replace", "understory_estonia_czech", R.robust_bands),
    Rule("bssl_tail_robust_smooth", "bssl", partial(R.tail_smoothed, start=2200, cut=2200, strength=12_000.0)),
    Rule("branch_tree_tail_robust_smooth", "branch_tree_spectra_boreal_temperate", partial(R.tail_smoothed, start=2300, cut=2300, strength=10_000.0)),
    Rule("hyspiri_out_of_range_segment_interp", "hyspiri_ground_targets", _bounded(R.segments)),
    Rule("hyspiri_tail_smoothed_extrapolated", "hyspiri_ground_targets", _bounded(partial(R.tail_extrapolated, start=2300, cut=2450, strength=8_000.0, hold=True))),
    Rule("natural_snow_tail_robust_smooth", "natural_snow_twigs", partial(R.tail_smoothed, start=2350, cut=2350, strength=12_000.0)),
    Rule("natural_snow_out_of_range_segment_interp", "natural_snow_twigs", partial(R.segments, low=2300)),
    Rule("ngee_arctic_2018_tail_smoothed_extrapolated", "ngee_arctic_2018", partial(R.tail_extrapolated, start=2300, cut=2450, strength=8_000.0, hold=False)),
    Rule("ngee_arctic_2018_out_of_range_segment_interp", "ngee_arctic_2018", partial(R.segments, low=2300)),
    Rule("santa_post800_strong_smooth_blend", "santa_barbara_urban_reflectance", R.smooth_above),
    bridge("santa_barbara_urban_reflectance", _shoulders("santa_absorption2_neighbor_interp", (1850, 1950), (1800, 1840), (1960, 2000), 10)),
    Rule("santa_tail_smoothed_extrapolated", "santa_barbara_urban_reflectance", partial(R.tail_extrapolated, start=2300, cut=2450, strength=8_000.0, hold=True)),
    bridge("sispec", _shoulders("sispec_absorption2_neighbor_interp", (1830, 1930), (1780, 1820), (1940, 1980), 10)),
    Rule("emit_adjusted_vegetation_visible_splice_interp", "emit_adjusted_vegetation", partial(R.visible_splice, skip_edge=True)),
    Rule("emit_l2a_surface_visible_splice_interp", "emit_l2a_surface", partial(R.visible_splice, skip_edge=False)),
]
#: Metrics (of operators/review.py) that make a row of a source worth a repair: any at its limit or above, "+" above 0.
ATTEMPT: dict[str, dict[str, float]] = {
    "bssl": {"max_abs_jump_tail_2300": 0.05, "tail_end_drift_2400": 0.06, "out_of_range_band_count": 1}, "branch_tree_spectra_boreal_temperate": {"max_abs_jump_tail_2300": 0.05, "tail_end_drift_2400": 0.07, "out_of_range_band_count": 1},
    "hyspiri_ground_targets": {"max_abs_jump_tail_2300": 0.05, "tail_end_drift_2400": 0.12, "out_of_range_band_count": 1}, "natural_snow_twigs": {"max_abs_jump_tail_2300": 0.045, "tail_end_drift_2400": 0.05, "out_of_range_band_count": 1},
    "ngee_arctic_2018": {"max_abs_jump_tail_2300": 0.05, "tail_end_drift_2400": 0.05, "out_of_range_band_count": 1}, "sispec": {"max_interp_spike_absorption2": 0.05},
    "emit_adjusted_vegetation": {"max_abs_jump_visible": 0.05}, "emit_l2a_surface": {"max_abs_jump_visible": 0.05},
}
ALWAYS, FLAGGED_SOURCE = "santa_barbara_urban_reflectance", "understory_estonia_czech"


def attempt(source: str = "source_id"):
    """Column: is a row of review metrics worth the repairs REMAINING?"""
    s = F.col(source)
    out = F.when(s == ALWAYS, True).when(~F.coalesce(F.col("is_suspicious"), F.lit(False)), False)
    out = out.when(s == FLAGGED_SOURCE, (F.col("flagged_band_count") >= F.col("source_flagged_band_threshold")) & (F.col("max_abs_residual") >= F.greatest(F.lit(0.10), F.col("source_residual_threshold"))))
    for name, limits in ATTEMPT.items():
        some = F.lit(False)
        for metric, limit in limits.items():
            some = some | F.coalesce(F.col(metric) >= limit, F.lit(False))
        out = out.when(s == name, some)
    return F.coalesce(out.otherwise(False), F.lit(False))


def _field(name: str, kind: str) -> StructField:
    return StructField(name, DataType.fromDDL(kind))


def _for(rule: Rule, source: str, group: str) -> bool:
    named = not rule.source or (source.startswith(rule.source[:-1]) if rule.source.endswith("*") else source == rule.source)
    return named and (not rule.group or group == rule.group)


def repaired(df: DataFrame, rules: Sequence[Rule], start: int = 400, values: str = "values", source: str = "source_id", group: str = "landcover_group", only: str | None = None) -> DataFrame:
    """df with repaired values and the column `repairs`. Rules are tried in order, each on what the one before left.

    only: a boolean column; other rows stay as they are, as do rows without an array.
    """
    kept = [f for f in df.schema.fields if f.name not in (values, "repairs")]
    schema = StructType([*kept, _field(values, "array<double>"), _field("repairs", REPAIRS)])
    has_group = group in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix(column(batch, values))
            x = np.arange(start, start + y.shape[1]).astype(float)
            sources = column(batch, source).to_pylist()
            groups = column(batch, group).to_pylist() if has_group else [None] * len(y)
            wanted = column(batch, only).fill_null(False).to_pylist() if only else [True] * len(y)
            done = []
            for k in range(len(y)):
                notes = []
                for rule in rules if wanted[k] and np.isfinite(y[k]).any() else []:
                    if not _for(rule, sources[k] or "", groups[k] or ""):
                        continue
                    new = rule.kernel(y[k], x)
                    if new is None:
                        continue
                    delta = np.abs(new - y[k])
                    at = np.flatnonzero((delta > 0) | (np.isfinite(new) & ~np.isfinite(y[k])))
                    known = delta[np.isfinite(delta) & (delta > 0)]
                    if len(at):
                        notes.append({"name": rule.name, "start_nm": x[at[0]], "end_nm": x[at[-1]], "changed": len(at), "mean_abs_delta": float(known.mean()) if len(known) else 0.0, "max_abs_delta": float(known.max(initial=0.0))})
                    y[k] = new
                done.append(notes)
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in kept], lists(y), pa.array(done, _REPAIRS)], names=schema.names)

    return df.mapInArrow(run, schema)


def report(done: DataFrame, *keys: str) -> DataFrame:
    """One row per repair: keys, name, start_nm, end_nm, changed, mean_abs_delta, max_abs_delta."""
    return done.select(*keys, F.inline("repairs"))


def by_source(reported: DataFrame, key: str = "spectrum_id") -> DataFrame:
    return reported.groupBy("source_id").agg(F.count("*").alias("repaired_windows"), F.countDistinct(key).alias("repaired_spectra"))


def best_variants(base: DataFrame, old: DataFrame, guarded: DataFrame, keys: Sequence[str], start: int = 400, windows: Mapping[str, str] = SMOOTHED) -> DataFrame:
    """guarded with the best variant in every window of its source, and `choices`: array of window and variant.

    The variant with the least boundary step, then largest step, then curvature is taken; the first of equal ones.
    """
    names = ("base", "old", "guarded")
    rows = guarded.join(base.select(*keys, F.col("values").alias("_base")), list(keys)).join(old.select(*keys, F.col("values").alias("_old")), list(keys))
    kept = [f for f in guarded.schema.fields if f.name != "values"]
    schema = StructType([*kept, _field("values", "array<double>"), _field("choices", "array<struct<window:string,variant:string>>")])
    choice = pa.list_(pa.struct([("window", pa.string()), ("variant", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [matrix(column(batch, c)) for c in ("_base", "_old", "values")]
            out, x, notes = given[2].copy(), np.arange(start, start + given[2].shape[1]).astype(float), []
            for k, s in enumerate(column(batch, "source_id").to_pylist()):
                own = []
                for w in (SMOOTH_WINDOWS[n] for n in windows.get(s, "").split()):
                    near = w.near(x, 50.0)
                    if near.any():
                        best = R.best_of([g[k] for g in given], x, w)
                        out[k, near] = given[best][k, near]
                        own.append({"window": w.name, "variant": names[best]})
                notes.append(own)
            yield pa.RecordBatch.from_arrays([*[column(batch, f.name) for f in kept], lists(out), pa.array(notes, choice)], names=schema.names)

    return rows.mapInArrow(run, schema)


def outlier_windows(df: DataFrame, start: int = 400, windows: Sequence[OutlierWindow] = OUTLIER_WINDOWS, visible_only: bool = False) -> DataFrame:
    """df with outliers of the windows replaced by their smooth, and `flagged`: the number of places in each window.

    visible_only: outliers are only found, and around those from 400 to 700 nm the visible's smooth fades in; then
    `flagged` has one more number, of the places that changed.
    """
    kept = [f for f in df.schema.fields if f.name not in ("values", "flagged")]
    schema = StructType([*kept, _field("values", "array<double>"), _field("flagged", "array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                y = matrix(column(part, "values"))
                x = np.arange(start, start + y.shape[1]).astype(float)
                if visible_only:
                    found = [R.flagged(y, x, [w])[0] for w in windows]
                    y, changed = R.blend_visible(y, x, np.any(found, axis=0))
                    counts = np.c_[np.stack([m.sum(axis=1) for m in found], axis=1), changed]
                else:
                    y, counts = R.replace_flagged(y, x, windows)
                yield pa.RecordBatch.from_arrays([*[column(part, f.name) for f in kept], lists(y), lists(counts.astype(np.int32), pa.int32(), False)], names=schema.names)

    return df.mapInArrow(run, schema)


def templated(df: DataFrame, template: np.ndarray, source: str = "ghisaconus_v001", group: str = "vegetation", start: int = 400, left: int = 420, right: int = 500, replace: R.Span = (430, 500)) -> DataFrame:
    """One source's spectra of a group with their blue end from a stretched template (a mean curve of other sources)."""
    rule = Rule("template_stretch", source, partial(R.stretched, template=np.asarray(template, float), left=left, right=right, replace=replace), group)
    return repaired(df, [rule], start)
