"""The whole rebuild of a library from normalised tables: curation and repairs in their order, then the package.

Each stage's tables are written and read again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation, repairs, review
from ..sources.files import exists
from . import package as packaging

KEY = ["source_id", "spectrum_id"]
Tables = dict[str, DataFrame]


def _repaired(rules: list[repairs.Rule]) -> Callable[[Tables], Tables]:
    def stage(t: Tables) -> Tables:
        groups = t["labels"].select(*KEY, "landcover_group").dropDuplicates(KEY)
        done = repairs.repaired(t["spectra"].join(groups, KEY, "left"), rules)
        return t | {"spectra": done.drop("landcover_group", "repairs"), "repairs": repairs.report(done, *KEY)}

    return stage


def _coverage(t: Tables) -> Tables:
    metadata, spectra, summary = curation.by_coverage(t["metadata"], t["spectra"], t["summary"], 0.8)
    return t | {"metadata": metadata, "spectra": spectra, "summary": summary}


def _of(t: Tables, metadata: DataFrame) -> Tables:
    return t | {"metadata": metadata, "spectra": curation.of_rows(t["spectra"], metadata), "summary": curation.rebuilt_summary(t["summary"], metadata, True)}


def _visible(t: Tables) -> Tables:
    done = repairs.outlier_windows(t["spectra"], visible_only=True)
    return t | {"spectra": done.drop("flagged")}


def _absorption(t: Tables) -> Tables:
    """Guarded smoothing, and in every window the best of the spectrum as it was, smoothed and guarded."""
    base = t["spectra"]
    guarded = repairs.repaired(base, repairs.GUARDED).drop("repairs")
    free = [repairs.Rule(r.name, r.source, partial(r.kernel, slack=float("inf")), r.group) for r in repairs.GUARDED]
    old = repairs.repaired(base, free).drop("repairs")
    return t | {"spectra": repairs.best_variants(base, old, guarded, KEY).drop("choices")}


def _native(t: Tables) -> Tables:
    return _of(t, curation.by_native_range(t["metadata"])[0])


def _subset(t: Tables) -> Tables:
    return _of(t, curation.by_rules(t["metadata"])["retained"])


def _remaining(t: Tables) -> Tables:
    """Repairs of the rows whose metrics ask for them."""
    marks = review.with_thresholds(review.metrics(t["spectra"].select(*KEY, "values"))).withColumn("is_suspicious", review.suspicious())
    wanted = marks.select(*KEY, repairs.attempt().alias("_wanted"))
    done = repairs.repaired(t["spectra"].join(wanted, KEY, "left"), repairs.REMAINING, only="_wanted")
    return t | {"spectra": done.drop("_wanted", "repairs"), "repairs": repairs.report(done, *KEY)}


STAGES: list[tuple[str, Callable[[Tables], Tables]]] = [
    ("02_coverage", _coverage), ("03_artifacts", _repaired(repairs.ARTIFACTS)), ("04_deep_windows", _repaired(repairs.DEEP_WINDOWS)), ("05_visible", _visible), ("06_absorption", _absorption), ("07_native_range", _native),
    ("08_vegetation_outliers", _repaired(repairs.VEGETATION_OUTLIERS)), ("09_vegetation_water", _repaired(repairs.VEGETATION_WATER)), ("10_subset", _subset), ("11_remaining", _remaining),
]


def rebuild(spark: SparkSession, tables: Tables, manifest: DataFrame, path: str, exclude_sources: list[str] | None = None, exclude_spectra: DataFrame | None = None) -> Tables:
    """Run all stages on metadata, spectra (values on 400 to 2500 nm), summary and labels, and build the package; its tables."""
    t = dict(tables)
    for name, stage in STAGES:
        after = stage(t)
        for key in {k for k in after if after[k] is not t.get(k)}:
            place = f"{path.rstrip('/')}/{name}/{key}"
            after[key].write.mode("overwrite").parquet(place)
            after[key] = spark.read.parquet(place)
        t = after
    labels = curation.of_rows(t["labels"], t["metadata"])
    return packaging.package(manifest, t["metadata"], t["spectra"].select(*packaging.KEYS, "values"), labels, exclude_sources or [], exclude_spectra)


def affected(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The repaired spectra of each stage that repairs, for the stage report."""
    out = {}
    for name, _ in STAGES:
        place = f"{path.rstrip('/')}/{name}/repairs"
        if exists(spark, place):
            out[name] = spark.read.parquet(place).select(*KEY, F.col("name").alias("repair"))
    return out
