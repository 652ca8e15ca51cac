"""Sensor definitions: bands with response curves, from JSON files or given in code, and their weights on the grid."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SENSOR, CodedError
from ..grid import CANONICAL, SEGMENTS, Grid

TOLERANCE = 1e-6
BRIDGE = "nir"  # the band of this id also serves the search in swir
SPLIT = 1000.0  # centers below are vnir

# Bands of the known sensors, by family: our id, the sensor's own id, segment.
FAMILIES = {
    "msi": "ultra_blue B01 vnir, blue B02 vnir, green B03 vnir, red B04 vnir, nir B08 vnir, swir1 B11 swir, swir2 B12 swir",
    "oli": "ultra_blue B1 vnir, blue B2 vnir, green B3 vnir, red B4 vnir, nir B5 vnir, swir1 B6 swir, swir2 B7 swir",
    "modis": "blue B3 vnir, green B4 vnir, red B1 vnir, nir B2 vnir, swir1 B6 swir, swir2 B7 swir",
    "viirs": "blue M2 vnir, green M4 vnir, red M5 vnir, nir M7 vnir, swir1 M10 swir, swir2 M11 swir",
}
KNOWN = {
    "sentinel-2a_msi": "msi", "sentinel-2b_msi": "msi", "sentinel-2c_msi": "msi", "landsat-8_oli": "oli", "landsat-9_oli2": "oli",
    "terra_modis": "modis", "snpp_viirs": "viirs", "noaa-20_viirs": "viirs", "noaa-21_viirs": "viirs",
}


@dataclass(frozen=True)
class Band:
    band_id: str
    segment: str
    wavelengths: tuple[float, ...]
    response: tuple[float, ...]
    center: float | None = None
    fwhm: float | None = None

    def checked(self, grid: Grid) -> Band:
        w, r = np.array(self.wavelengths, float), np.array(self.response, float)
        about = {"band_id": self.band_id, "segment": self.segment}
        if not self.band_id:
            raise CodedError(SENSOR, "a band needs an id")
        if self.segment not in SEGMENTS:
            raise CodedError(SENSOR, "a band's segment is vnir or swir", **about)
        if not len(w) or len(w) != len(r):
            raise CodedError(SENSOR, "wavelengths and responses must be as many, and one at least", **about)
        if not (np.isfinite(w).all() and np.isfinite(r).all()):
            raise CodedError(SENSOR, "wavelengths and responses must be finite", **about)
        if (np.diff(w) <= 0).any():
            raise CodedError(SENSOR, "wavelengths must increase", **about)
        if not (r > 0).any():
            raise CodedError(SENSOR, "no response is positive", **about)
        lo, hi = grid.range_of(self.segment)
        if w[r > 0].min() < lo - TOLERANCE or w[r > 0].max() > hi + TOLERANCE:
            raise CodedError(SENSOR, "the band reaches out of its segment", **about)
        return self

    def weights(self, grid: Grid) -> np.ndarray:
        """Response on the grid, 0 outside the band's segment and curve, of sum 1."""
        on = np.interp(grid.wavelengths.astype(float), self.wavelengths, self.response, left=0.0, right=0.0)
        inside = np.zeros(grid.width, bool)
        inside[grid.part(self.segment)] = True
        on = np.where(inside, on, 0.0)
        if on.sum() <= 0:
            raise CodedError(SENSOR, "the response on the grid is not positive", band_id=self.band_id, segment=self.segment)
        return on / on.sum()

    def as_dict(self) -> dict[str, object]:
        return {"band_id": self.band_id, "response_definition": {"kind": "sampled", "wavelength_nm": list(self.wavelengths), "response": list(self.response)}, "segment": self.segment}


@dataclass(frozen=True)
class Sensor:
    sensor_id: str
    bands: tuple[Band, ...]

    def __post_init__(self) -> None:
        ids = [b.band_id for b in self.bands]
        if not ids:
            raise CodedError(SENSOR, "a sensor needs a band", sensor_id=self.sensor_id)
        if len(set(ids)) < len(ids):
            raise CodedError(SENSOR, "band ids must differ", sensor_id=self.sensor_id, band_ids=ids)

    @property
    def band_ids(self) -> list[str]:
        return [b.band_id for b in self.bands]

    def own(self, segment: str) -> list[int]:
        """Places of the segment's bands."""
        return [k for k, b in enumerate(self.bands) if b.segment == segment]

    def searched(self, segment: str) -> list[int]:
        """Places of the bands that neighbours are searched by: the segment's, and in swir the bridging band."""
        return [k for k, b in enumerate(self.bands) if b.segment == segment or (segment == "swir" and b.band_id == BRIDGE)]

    def weights(self, grid: Grid, places: Iterable[int] | None = None) -> np.ndarray:
        """Matrix (grid width, bands): simulated band values are spectra times it."""
        picked = range(len(self.bands)) if places is None else places
        cols = [self.bands[k].weights(grid) for k in picked]
        return np.stack(cols, axis=1) if cols else np.zeros((grid.width, 0))

    def as_dict(self) -> dict[str, object]:
        return {"sensor_id": self.sensor_id, "bands": [b.as_dict() for b in self.bands]}


def center_of(wavelengths: Sequence[float], response: Sequence[float]) -> float | None:
    """Response-weighted mean over positive responses; the plain mean where there is none."""
    w, r = np.array(wavelengths, float), np.array(response, float)
    if not len(w) or len(w) != len(r):
        return None
    return float(np.average(w[r > 0], weights=r[r > 0])) if (r > 0).any() else float(w.mean())


def gaussian(center: float, fwhm: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A curve for a band given by center and width only: a Gaussian sampled each nanometre to three deviations."""
    sd = fwhm / (2 * np.sqrt(2 * np.log(2)))
    w = np.arange(np.ceil(center - 3 * sd), np.floor(center + 3 * sd) + 1)
    return tuple(w.tolist()), tuple(np.exp(-0.5 * ((w - center) / sd) ** 2).tolist())


def _segment_in(band: Mapping) -> str | None:
    """The band's own segment, or that of whichever extension gives one."""
    extensions = band.get("extensions")
    inner = extensions.values() if isinstance(extensions, Mapping) else []
    found = [band.get("segment"), *[e.get("segment") for e in inner if isinstance(e, Mapping)]]
    return next((str(s) for s in found if s), None)


def clipped(wavelengths: Sequence[float], response: Sequence[float], segment: str, grid: Grid, band_id: str, low: float | None = None, high: float | None = None) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The curve inside its support, its segment and the grid."""
    w, r = np.array(wavelengths, float), np.array(response, float)
    positive = w[r > 0]
    if not len(positive):
        raise CodedError(SENSOR, "no response is positive", band_id=band_id)
    a, b = grid.range_of(segment)
    lo = max(grid.start, a, positive.min() if low is None else low)
    hi = min(grid.end, b, positive.max() if high is None else high)
    keep = (w >= lo) & (w <= hi)
    if lo > hi or not (r[keep] > 0).any():
        raise CodedError(SENSOR, "the band does not overlap its segment", band_id=band_id, segment=segment)
    return tuple(w[keep].tolist()), tuple(r[keep].tolist())


def _band(given: Band | Mapping, place: int, ids: str, segments: str, grid: Grid) -> Band:
    if isinstance(given, Band):
        return given.checked(grid)
    if not isinstance(given, Mapping):
        raise CodedError(SENSOR, "a band is a mapping or a Band", kind=type(given).__name__)
    name = str(given.get("band_id") or "").strip() if ids == "preserve" else ""
    name = name or f"band_{place + 1}"
    curve = given.get("response_definition")
    curve = dict(curve) if isinstance(curve, Mapping) else {}
    first = lambda *values: next((float(v) for v in values if v not in (None, "")), None)
    center = first(given.get("center_wavelength_nm"), given.get("center_nm"), curve.get("center_wavelength_nm"), curve.get("center_nm"))
    fwhm = first(given.get("fwhm_nm"), curve.get("fwhm_nm"))
    if curve.get("wavelength_nm"):
        pairs = sorted(zip(map(float, curve["wavelength_nm"]), map(float, curve.get("response") or [])))
        if len(pairs) != len(curve["wavelength_nm"]):
            raise CodedError(SENSOR, "wavelengths and responses must be as many", band_id=name)
        w, r = zip(*pairs)
    elif center is not None and fwhm is not None:
        w, r = gaussian(center, fwhm)
    else:
        raise CodedError(SENSOR, "a band needs a curve, or center and width", band_id=name)
    center = center_of(w, r) if center is None else center
    segment = _segment_in(given)
    if segment is None:
        if segments != "center_wavelength" or center is None:
            raise CodedError(SENSOR, "the band's segment must be given", band_id=name)
        segment = "vnir" if center < SPLIT else "swir"
    if segment not in SEGMENTS:
        raise CodedError(SENSOR, "a band's segment is vnir or swir", band_id=name, segment=segment)
    w, r = clipped(w, r, segment, grid, name, first(given.get("support_min_nm")), first(given.get("support_max_nm")))
    return Band(name, segment, w, r, center, fwhm).checked(grid)


def sensor_of(given: Sensor | Mapping, grid: Grid = CANONICAL, segments: str | None = None) -> Sensor:
    """A sensor from a definition. band_id_policy: preserve or deterministic (band_1, ...); segment_policy: explicit or
    center_wavelength. Without an id, one is made from a digest of its bands."""
    if isinstance(given, Sensor):
        for b in given.bands:
            b.checked(grid)
        return given
    bands = given.get("bands") if isinstance(given, Mapping) else None
    if not isinstance(bands, Sequence) or isinstance(bands, (str, bytes)):
        raise CodedError(SENSOR, "a sensor definition needs a list of bands")
    ids, policy = given.get("band_id_policy") or "preserve", segments or given.get("segment_policy") or "center_wavelength"
    if ids not in ("preserve", "deterministic") or policy not in ("explicit", "center_wavelength"):
        raise CodedError(SENSOR, "unknown policy", band_id_policy=ids, segment_policy=policy)
    made = tuple(_band(b, k, ids, policy, grid) for k, b in enumerate(bands))
    name = str(given.get("sensor_id") or "").strip()
    if not name:
        body = json.dumps([b.as_dict() for b in made], sort_keys=True)
        name = f"custom_{hashlib.sha256(body.encode()).hexdigest()[:12]}"
    return Sensor(name, made)


def known_sensor(sensor_id: str, curves: Mapping[str, tuple[Sequence[float], Sequence[float]]], grid: Grid = CANONICAL) -> Sensor:
    """A known sensor from curves under its own band ids, with our ids and segments; curves are not shipped."""
    if sensor_id not in KNOWN:
        raise CodedError(SENSOR, "unknown sensor", sensor_id=sensor_id, known=sorted(KNOWN))
    rows = [r.split() for r in FAMILIES[KNOWN[sensor_id]].split(", ")]
    missing = [own for _, own, _ in rows if own not in curves]
    if missing:
        raise CodedError(SENSOR, "curves are missing", sensor_id=sensor_id, band_ids=missing)
    return Sensor(sensor_id, tuple(_band({"band_id": ours, "segment": s, "response_definition": {"wavelength_nm": list(curves[own][0]), "response": list(curves[own][1])}}, k, "preserve", "explicit", grid) for k, (ours, own, s) in enumerate(rows)))


def read_sensor_files(spark: SparkSession, path: str, wanted: Sequence[str] | None = None, grid: Grid = CANONICAL) -> dict[str, Sensor]:
    """All sensor definitions (*.json) under the path by id, read by Spark's file source; an id given twice is an error."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    out: dict[str, Sensor] = {}
    for r in files.select(F.col("_metadata.file_path").alias("path"), "value").orderBy("path").toLocalIterator():
        try:
            given = json.loads(r["value"])
        except ValueError as e:
            raise CodedError(SENSOR, "a sensor file is not JSON", path=r["path"]) from e
        sensor = sensor_of(given, grid)
        if sensor.sensor_id in out:
            raise CodedError(SENSOR, "a sensor id is given twice", sensor_id=sensor.sensor_id, path=r["path"])
        out[sensor.sensor_id] = sensor
    missing = [s for s in wanted or [] if s not in out]
    if missing or not out:
        raise CodedError(SENSOR, "sensors could not be found", missing=missing, path=path)
    return out


def sensor_frame(spark: SparkSession, sensors: Iterable[Sensor]) -> DataFrame:
    """One row per band."""
    rows = [(s.sensor_id, k, b.band_id, b.segment, list(b.wavelengths), list(b.response), b.center, b.fwhm) for s in sensors for k, b in enumerate(s.bands)]
    return spark.createDataFrame(rows, "sensor_id string, band_index int, band_id string, segment string, wavelength_nm array<double>, rsr array<double>, center_nm double, fwhm_nm double")
