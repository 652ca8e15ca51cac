"""SpectralMapper-like facade: band values of one sensor to another sensor, to a segment or to the whole spectrum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import INPUT, CodedError
from ..grid import SEGMENTS
from ..operators.estimators import blended, policy
from ..operators.indexing import with_index
from . import linear, retrieval
from .kernels import ESTIMATORS
from .prepare import Prepared, opened

MODES = ("target_sensor", "vnir_spectrum", "swir_spectrum", "full_spectrum")
#: All search exactly; the names are accepted so that requests stay valid. Approximate search is operators/ann.py.
BACKENDS = ("numpy", "scipy_ckdtree", "faiss", "pynndescent", "scann")
_REASONS = {
    "target_sensor": "no target segment could be retrieved", "vnir_spectrum": "the vnir segment needs enough valid bands",
    "swir_spectrum": "the swir segment needs enough valid bands", "full_spectrum": "both segments need enough valid bands",
}


class Mapper:
    """Maps queries by the neighbours of a prepared library.

    A batch is a DataFrame with sample_id, values (array in the source sensor's band order) and, if wanted, valid
    (array of booleans), exclude_row_id and sample_index. Results are DataFrames; samples that can't be mapped keep a
    row with `error`, and `checked` raises for the first of them.
    """

    def __init__(self, library: Prepared | str, spark: SparkSession | None = None, check: bool = False) -> None:
        self.library = opened(spark or SparkSession.active(), library, check) if isinstance(library, str) else library
        self.spark = self.library.library.sparkSession
        self._cached: list[DataFrame] = []

    def __enter__(self) -> Mapper:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def cache(self) -> Mapper:
        """Keep the library's rows in memory until close()."""
        self.library.library = self.library.library.persist()
        self._cached.append(self.library.library)
        return self

    def close(self) -> None:
        while self._cached:
            self._cached.pop().unpersist()

    # requests

    def candidate_rows(self, include: Sequence[int] | None = None, exclude_row_ids: Sequence[str] = (), exclude_sample_names: Sequence[str] = ()) -> DataFrame:
        """row_index of the rows that may be neighbours; unknown rows, ids or names, and an empty outcome, are errors."""
        rows = self.library.library.select("row_index", "row_id", "sample_name")
        if include is not None:
            wanted = sorted({int(r) for r in include})
            known = self.spark.createDataFrame([(r,) for r in wanted], "row_index long")
            unknown = [r[0] for r in known.join(rows, "row_index", "left_anti").limit(10).collect()]
            if unknown or not wanted:
                raise CodedError(INPUT, "candidate rows must be rows of the library, one at least", unknown=unknown)
            rows = rows.join(F.broadcast(known), "row_index", "left_semi")
        for name, given in (("row_id", exclude_row_ids), ("sample_name", exclude_sample_names)):
            texts = sorted({t for t in (str(v).strip() for v in given or ()) if t})
            if texts:
                out = self.spark.createDataFrame([(t,) for t in texts], f"{name} string")
                unknown = [r[0] for r in out.join(self.library.library, name, "left_anti").limit(10).collect()]
                if unknown:
                    raise CodedError(INPUT, f"excluded {name} values must be in the library", unknown=unknown)
                rows = rows.join(F.broadcast(out), name, "left_anti")
        if (exclude_row_ids or exclude_sample_names) and rows.isEmpty():
            raise CodedError(INPUT, "the exclusions leave no row of the library")
        return rows.select("row_index")

    def has_sample_name(self, name: str) -> bool:
        return not self.library.library.where(F.col("sample_name") == str(name).strip()).isEmpty()

    def sensor(self, sensor_id: str):
        return self.library.sensor(sensor_id)

    @staticmethod
    def _checked_request(mode: str, target: str | None, k: int, least: int, estimator: str, backend: str, eps: float) -> None:
        for ok, message, context in (
            (mode in MODES, "unknown output mode", {"output_mode": mode, "known": MODES}), (k >= 1, "k must be 1 at least", {"k": k}), (least >= 1, "min_valid_bands must be 1 at least", {"min_valid_bands": least}),
            (estimator in ESTIMATORS, "unknown estimator", {"estimator": estimator, "known": ESTIMATORS}), (backend in BACKENDS, "unknown backend", {"backend": backend, "known": BACKENDS}),
            (eps >= 0, "eps must not be negative", {"eps": eps}), (mode != "target_sensor" or bool(target), "target_sensor mode needs a target sensor", {}),
        ):
            if not ok:
                raise CodedError(INPUT, message, **context)

    def _queries(self, batch: DataFrame, width: int, self_exclude: bool) -> DataFrame:
        """The batch as retrieval takes it; an exclude_row_id that the library lacks is an error of its sample."""
        given = batch if "sample_index" in batch.columns else with_index(batch, "sample_index")
        have = lambda c, kind: F.col(c).cast(kind) if c in given.columns else F.lit(None).cast(kind)
        own = F.nullif(F.trim(have("exclude_row_id", "string")), F.lit(""))
        out = given.select("sample_index", F.col("sample_id").cast("string").alias("sample_id"), F.col("values").cast("array<double>").alias("q"), have("valid", "array<boolean>").alias("valid"), own.alias("exclude_row_id"))
        wrong = (F.size("q") != width) | (F.size("valid") != width)
        out = out.withColumn("problem", F.when(F.coalesce(wrong, F.col("q").isNull()), "values and valid must have one element a band"))
        blank = F.array_repeat(F.lit(None).cast("double"), width)
        out = out.withColumn("q", F.when(F.col("problem").isNull(), F.col("q")).otherwise(blank)).withColumn("valid", F.when(F.col("problem").isNull(), F.col("valid")))
        if "exclude_row_id" in given.columns:
            ids = self.library.library.select(F.col("row_id").alias("exclude_row_id"), F.col("row_index").alias("exclude_row"))
            out = out.join(ids, "exclude_row_id", "left")
            out = out.withColumn("problem", F.coalesce("problem", F.when(F.col("exclude_row_id").isNotNull() & F.col("exclude_row").isNull(), "exclude_row_id must be in the library")))
        else:
            out = out.withColumn("exclude_row", F.lit(None).cast("long"))
        if self_exclude:
            names = self.library.library.select(F.col("sample_name").alias("sample_id"), F.col("name_code").alias("exclude_name")).distinct()
            out = out.join(names, "sample_id", "left")
        else:
            out = out.withColumn("exclude_name", F.lit(None).cast("long"))
        some = F.exists(F.zip_with("q", F.coalesce("valid", F.array_repeat(F.lit(True), width)), lambda v, ok: v.isNotNull() & ~F.isnan(v) & F.coalesce(ok, F.lit(False))), lambda x: x)
        return out.withColumn("problem", F.coalesce("problem", F.when(~some, "one valid band is needed at least")))

    # mapping

    def retrieved(
        self, batch: DataFrame, source: str, mode: str = "target_sensor", target: str | None = None, k: int = 10, min_valid_bands: int = 1, estimator: str = "mean", backend: str = "numpy", eps: float = 0.0,
        candidates: DataFrame | None = None, self_exclude: bool = False, ship_bytes: int = retrieval.SHIP_BYTES,
    ) -> DataFrame:
        """Queries with a struct per segment (retrieval.FOUND): the rich form that results and diagnostics come from."""
        self._checked_request(mode, target, k, min_valid_bands, estimator, backend, eps)
        lib, sensor = self.library, self.library.sensor(source)
        goal = lib.sensor(target) if target else None
        rows = self._queries(batch, len(sensor.bands), self_exclude)
        for s in SEGMENTS:
            features = lib.features(source, s).select("row_index", "name_code", F.col("x").cast("array<double>").alias("x"))
            payload = lib.projection(goal, s) if mode == "target_sensor" else lib.spectra(s) if mode in (f"{s}_spectrum", "full_spectrum") else None
            width = len(goal.own(s)) if mode == "target_sensor" else lib.grid.width_of(s)
            if candidates is not None:
                features = features.join(F.broadcast(candidates), "row_index", "left_semi")
                payload = payload.join(F.broadcast(candidates), "row_index", "left_semi") if payload is not None else None
            rows = retrieval.retrieve(rows, s, features, payload, sensor.searched(s), k, min_valid_bands, estimator, ship_bytes, lib.rows, width)
        return rows

    def _error(self, mode: str, target: str | None) -> Column:
        ok = {s: F.col(f"{s}.ok") for s in SEGMENTS}
        if mode == "target_sensor":
            goal = self.library.sensor(target)
            good = F.lit(False)
            for s in SEGMENTS:
                good = good | (ok[s] if goal.own(s) else F.lit(False))
        else:
            good = ok["vnir"] & ok["swir"] if mode == "full_spectrum" else ok[mode.split("_")[0]]
        empty = F.lit(False)
        for s in SEGMENTS:
            empty = empty | (F.coalesce(F.col(f"{s}.reason"), F.lit("")) == retrieval.EMPTY)
        why = F.coalesce("problem", F.when(empty & ~good, "the exclusions leave no row of the library"), F.when(~good, _REASONS[mode]))
        return F.when(why.isNotNull(), F.struct(F.lit(INPUT).alias("code"), why.alias("message")))

    def _values(self, mode: str, target: str | None) -> Column:
        if mode == "target_sensor":
            goal = self.library.sensor(target)
            places = {p: (s, i) for s in SEGMENTS for i, p in enumerate(goal.own(s))}
            return F.array(*[F.when(F.col(f"{places[p][0]}.ok"), F.get(F.col(f"{places[p][0]}.values"), F.lit(places[p][1]))) for p in range(len(goal.bands))])
        if mode == "full_spectrum":
            return blended(F.col("vnir.values"), F.col("swir.values"), self.library.grid)
        return F.col(f"{mode.split('_')[0]}.values")

    @staticmethod
    def _merged(field: str) -> Column:
        """Mean over the segments that are ok, weighted by their valid bands; 0 without one."""
        weight = {s: F.when(F.col(f"{s}.ok"), F.greatest(F.col(f"{s}.valid_count"), F.lit(1))).otherwise(0).cast("double") for s in SEGMENTS}
        total = weight["vnir"] + weight["swir"]
        value = sum((weight[s] * F.coalesce(F.col(f"{s}.{field}"), F.lit(0.0)) for s in SEGMENTS), F.lit(0.0))
        return F.when(total > 0, value / total).otherwise(0.0)

    def results(self, found: DataFrame, mode: str, target: str | None = None, diagnostics: bool = False) -> DataFrame:
        """sample_index, sample_id, reflectance, source_fit_rmse, confidence, level, policy, error[, vnir, swir structs]."""
        out = found.withColumn("error", self._error(mode, target))
        fine = F.col("error").isNull()
        values = F.when(fine, self._values(mode, target))
        out = out.withColumn("reflectance", values).withColumn("source_fit_rmse", F.when(fine, self._merged("rmse"))).withColumn("confidence", F.when(fine, self._merged("confidence")))
        more = [*SEGMENTS] if diagnostics else []
        return policy(out).select("sample_index", "sample_id", "reflectance", "source_fit_rmse", "confidence", "level", "policy", "error", *more)

    def map_batch(self, batch: DataFrame, source: str, mode: str = "target_sensor", target: str | None = None, diagnostics: bool = False, **options) -> DataFrame:
        return self.results(self.retrieved(batch, source, mode, target, **options), mode, target, diagnostics)

    @staticmethod
    def checked(results: DataFrame) -> DataFrame:
        """The results, or the coded error of the first sample that has one."""
        bad = results.where("error is not null").orderBy("sample_index").select("sample_index", "sample_id", "error").head(1)
        if bad:
            r = bad[0]
            raise CodedError(r["error"]["code"], r["error"]["message"], sample_index=r["sample_index"], sample_id=r["sample_id"])
        return results

    def map_one(self, values: Sequence[float] | Mapping[str, float], source: str, valid: Sequence[bool] | Mapping[str, bool] | None = None, exclude_row_id: str | None = None, **options) -> dict[str, object]:
        """One sample as a dictionary, with the segments' diagnostics; values in band order or by band id."""
        bands = self.library.sensor(source).band_ids
        if isinstance(values, Mapping):
            if valid is not None and not isinstance(valid, Mapping):
                raise CodedError(INPUT, "values by band id need flags by band id")
            row = [values.get(b) for b in bands]
            ok = [bool((valid or {}).get(b, True)) for b in bands]
        else:
            row, ok = list(values), list(valid) if valid is not None else [True] * len(values)
        row = [None if v is None or not np.isfinite(v) else float(v) for v in row]
        batch = self.spark.createDataFrame([(0, "sample_000001", row, ok, exclude_row_id)], "sample_index long, sample_id string, values array<double>, valid array<boolean>, exclude_row_id string")
        return self.checked(self.map_batch(batch, source, diagnostics=True, **options)).first().asDict(True)

    def map_arrays(self, values: np.ndarray, source: str, valid: np.ndarray | None = None, **options) -> tuple[np.ndarray, np.ndarray]:
        """(reflectance rows, source fit errors) of a matrix that the caller holds in memory."""
        rows = [(k, f"sample_{k + 1:06d}", [float(v) if np.isfinite(v) else None for v in r], None if valid is None else [bool(x) for x in valid[k]]) for k, r in enumerate(np.asarray(values, float))]
        if not rows:
            raise CodedError(INPUT, "one sample is needed at least")
        batch = self.spark.createDataFrame(rows, "sample_index long, sample_id string, values array<double>, valid array<boolean>")
        found = self.checked(self.map_batch(batch, source, **options)).orderBy("sample_index").collect()
        return np.array([[np.nan if v is None else v for v in r["reflectance"]] for r in found]), np.array([r["source_fit_rmse"] for r in found])

    def compile_linear(self, source: str, mode: str = "target_sensor", target: str | None = None, rows: DataFrame | None = None) -> linear.LinearMapper:
        """Least squares from the source's simulated bands to the mode's output over the library (or some of its rows)."""
        self._checked_request(mode, target, 1, 1, "mean", "numpy", 0.0)
        pairs = self.training(source, mode, target)
        if rows is not None:
            pairs = pairs.join(F.broadcast(rows), "row_index", "left_semi")
        return linear.fit(pairs)

    def training(self, source: str, mode: str, target: str | None = None) -> DataFrame:
        """row_index, x (source bands), y (true output) of every library row."""
        lib = self.library
        x = lib.simulated(lib.sensor(source)).select("row_index", "x")
        if mode == "target_sensor":
            y = lib.simulated(lib.sensor(target)).select("row_index", F.col("x").alias("y"))
        else:
            whole = blended(F.col("vnir").cast("array<double>"), F.col("swir").cast("array<double>"), lib.grid)
            y = lib.library.select("row_index", (whole if mode == "full_spectrum" else F.col(mode.split("_")[0]).cast("array<double>")).alias("y"))
        return x.join(y, "row_index")

    # reports

    def neighbor_review(self, found: DataFrame, about: Mapping[str, object] | None = None) -> DataFrame:
        """One row per sample, segment and neighbour, with the row's identity and the band values as JSON; a segment
        without neighbours keeps one row with a null rank. found: results with diagnostics."""
        one = [F.struct(F.lit(s).alias("segment"), F.col(s).alias("f")) for s in SEGMENTS]
        rows = found.select("sample_index", "sample_id", F.explode(F.array(*one)).alias("s")).select("sample_index", "sample_id", "s.segment", "s.f")
        near = F.arrays_zip(*[F.col(f"f.{c}").alias(c) for c in ("rows", "distances", "weights", "bands")])
        rows = rows.select("sample_index", "sample_id", "segment", F.when(F.col("f.ok"), "ok").otherwise(F.col("f.reason")).alias("status"), F.col("f.valid_count").alias("valid_band_count"), F.col("f.rmse").alias("source_fit_rmse"), F.col("f.confidence").alias("confidence"), F.posexplode_outer(near).alias("at", "n"))
        names = self.library.library.select(F.col("row_index").alias("neighbor_row"), "row_id", "source_id", "spectrum_id", "sample_name")
        rows = rows.select("*", F.col("n.rows").alias("neighbor_row")).join(names, "neighbor_row", "left")
        out = policy(rows).select(
            "sample_index", "sample_id", "segment", "status", "valid_band_count", "source_fit_rmse", "confidence", "level", "policy", (F.col("at") + 1).cast("long").alias("neighbor_rank"),
            F.col("row_id").alias("neighbor_id"), "source_id", "spectrum_id", "sample_name", F.col("n.distances").alias("neighbor_distance"), F.col("n.weights").alias("neighbor_weight"), F.to_json("n.bands").alias("neighbor_band_values"),
        )
        for name, value in (about or {}).items():
            out = out.withColumn(name, F.lit(value))
        return out
