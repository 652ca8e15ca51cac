"""Command line: python -m prismora COMMAND. Exit 0, or 2 with a coded error on standard error (JSON with --json-errors)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import USAGE, CodedError
from .grid import CANONICAL, SEGMENTS
from .mapping import benchmark as bench
from .mapping import zarr
from .mapping.kernels import ESTIMATORS
from .mapping.mapper import BACKENDS, MODES, Mapper
from .mapping.prepare import build, opened, validate
from .operators import ann, curation
from .plans import package, reports, source_catalogue
from .sources import fetch, normalize, tables
from .sources.archive import download_library
from .sources.files import read_text, write_text
from .sources.sensors import read_sensor_files


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("prismora").getOrCreate()


def listed(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _json(spark: SparkSession, path: str, value: object) -> None:
    text = json.dumps(value, indent=2, sort_keys=True, default=str)
    if path:
        write_text(spark, path, text + "\n")
    else:
        print(text)


def _mapper(spark: SparkSession, a: argparse.Namespace) -> Mapper:
    if not a.prepared_root:
        raise CodedError(USAGE, "a prepared library must be given: --prepared-root")
    return Mapper(a.prepared_root, spark)


def build_library(spark: SparkSession, a: argparse.Namespace) -> None:
    root = a.library_root.rstrip("/")
    rows, gaps = tables.read_library(spark, f"{root}/tabular/spectra_metadata.csv", f"{root}/tabular/normalized_spectra.csv")
    sensors = read_sensor_files(spark, a.srf_root, a.source_sensor)
    made = build(spark, rows, sensors.values(), a.output_root, CANONICAL, a.dtype, {"interpolation": gaps, "source_sensors": a.source_sensor})
    for backend in a.knn_index_backend:
        for name in a.source_sensor:
            for s in SEGMENTS:
                features = made.features(name, s).select(F.col("row_index").alias("row_id"), "x")
                ann.save(ann.build(features), f"{a.output_root.rstrip('/')}/indexes/{backend}/{name}/{s}")
    _json(spark, "", {"output_root": a.output_root, "row_count": made.rows, "interpolation": gaps})


def download(spark: SparkSession, a: argparse.Namespace) -> None:
    download_library(spark, a.url, a.output_root, a.sha256 or None, not a.no_verify)


def _options(a: argparse.Namespace) -> dict[str, object]:
    return {"k": a.k, "min_valid_bands": a.min_valid_bands, "estimator": a.neighbor_estimator, "backend": a.knn_backend, "eps": a.knn_eps}


def _outputs(m: Mapper, a: argparse.Namespace) -> tuple[list[str] | None, list[str] | None, int]:
    """(names, segments, first wavelength) of the values of the output mode."""
    if a.output_mode == "target_sensor":
        goal = m.sensor(a.target_sensor)
        return goal.band_ids, [b.segment for b in goal.bands], 0
    grid = m.library.grid
    return None, None, grid.start if a.output_mode == "full_spectrum" else grid.range_of(a.output_mode.split("_")[0])[0]


def _mapped(m: Mapper, a: argparse.Namespace, batch: DataFrame, self_exclude: bool = False) -> DataFrame:
    some = m.candidate_rows(None, a.exclude_row_id, a.exclude_sample_name) if a.exclude_row_id or a.exclude_sample_name else None
    found = m.map_batch(batch, a.source_sensor, a.output_mode, a.target_sensor or None, True, candidates=some, self_exclude=self_exclude, **_options(a))
    return m.checked(found)


def _extras(spark: SparkSession, m: Mapper, a: argparse.Namespace, found: DataFrame) -> None:
    about = {"source_sensor": a.source_sensor, "target_sensor": a.target_sensor, "output_mode": a.output_mode, "k": a.k, "neighbor_estimator": a.neighbor_estimator, "knn_backend": a.knn_backend, "knn_eps": a.knn_eps}
    if a.neighbor_review_output:
        m.neighbor_review(found, about).write.mode("overwrite").option("header", True).csv(a.neighbor_review_output)
    if a.diagnostics_output:
        found.select("sample_index", "sample_id", "source_fit_rmse", "confidence", "level", "policy", *SEGMENTS).write.mode("overwrite").json(a.diagnostics_output)


def map_one(spark: SparkSession, a: argparse.Namespace) -> None:
    m = _mapper(spark, a)
    values, flags = tables.read_query(spark, a.input)
    bands = m.sensor(a.source_sensor).band_ids
    row = [values.get(b) for b in bands]
    ok = [bool((flags or {}).get(b, True)) for b in bands]
    batch = spark.createDataFrame([(0, "sample_000001", row, ok)], "sample_index long, sample_id string, values array<double>, valid array<boolean>")
    found = _mapped(m, a, batch)
    tables.write_result(found, a.output, *_outputs(m, a))
    _extras(spark, m, a, found)


def map_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    m = _mapper(spark, a)
    batch = tables.queries_with_index(spark, a.input, m.sensor(a.source_sensor).band_ids)
    found = _mapped(m, a, batch, a.self_exclude_sample_id)
    names, _, start = _outputs(m, a)
    width = {"vnir_spectrum": m.library.grid.width_of("vnir"), "swir_spectrum": m.library.grid.width_of("swir")}.get(a.output_mode, m.library.grid.width)
    axis = names or [start + i for i in range(width)]
    if a.output_format == "zarr":
        zarr.write_zarr(found, a.output, "band_id" if names else "wavelength_nm", axis, {"source_sensor": a.source_sensor, "output_mode": a.output_mode}, a.output_chunk_size)
    else:
        tables.write_results(found, a.output, [str(n) if names else f"nm_{n}" for n in axis], "reflectance")
    _extras(spark, m, a, found)


def benchmark_mapping(spark: SparkSession, a: argparse.Namespace) -> None:
    m = _mapper(spark, a)
    rows = bench.benchmark(m, a.source_sensor, a.target_sensor, a.k, a.test_fraction, a.max_test_rows or None, a.random_seed, a.neighbor_estimator, a.knn_backend, a.knn_eps)
    held = rows.toPandas()  # a row a band of four blocks
    report: dict[str, object] = {"source_sensor_id": a.source_sensor, "target_sensor_id": a.target_sensor, "k": a.k, "random_seed": a.random_seed}
    for (block, method), d in held.sort_values("band").groupby(["block", "method"]):
        part = {"mean_rmse": d["rmse"].mean(), "mean_mae": d["mae"].mean(), "mean_abs_bias": d["bias"].abs().mean(), "per_band_rmse": d["rmse"].tolist(), "per_band_mae": d["mae"].tolist(), "per_band_bias": d["bias"].tolist()}
        report.setdefault(block, {})[method] = part
    _json(spark, a.report, report)


def validate_library(spark: SparkSession, a: argparse.Namespace) -> None:
    p = opened(spark, a.prepared_root)
    manifest = json.loads(read_text(spark, f"{a.prepared_root.rstrip('/')}/manifest.json"))
    if a.no_verify_checksums:
        p.path = None
    validate(p, manifest)
    _json(spark, "", {"prepared_root": a.prepared_root, "row_count": manifest["row_count"], "valid": True})


def _wanted(a: argparse.Namespace) -> dict[str, list[str]]:
    return {"source_id": listed(a.source_ids), "tier": listed(a.tiers), "status": listed(a.statuses), "fetch_adapter": listed(a.adapters)}


def plan_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    _json(spark, a.output, fetch.matrix(tables.read_manifest(spark, a.manifest), a.limit or None, **_wanted(a)))


def fetch_source(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = curation.selected(tables.read_manifest(spark, a.manifest), source_id=[a.source_id]).collect()
    if not rows:
        raise CodedError(USAGE, "unknown source", source_id=a.source_id)
    _json(spark, "", fetch.fetch(rows[0].asDict(), a.output_root, a.fetch_mode == "assets", fetch.Http(a.user_agent)))


def fetch_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = curation.selected(tables.read_manifest(spark, a.manifest), **_wanted(a))
    done = fetch.fetch_all(spark, rows, a.output_root, a.fetch_mode == "assets", fetch.Http(a.user_agent), a.continue_on_error)
    _json(spark, "", {"selected_sources": done.count(), "status_counts": {r["status"]: r["n"] for r in curation.status_counts(done).collect()}})


def assemble(spark: SparkSession, a: argparse.Namespace) -> None:
    _json(spark, "", source_catalogue.assemble(spark, tables.read_manifest(spark, a.manifest), a.results_root, a.output_root))


def tidy(spark: SparkSession, a: argparse.Namespace) -> None:
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(a.results_root)
    folders = [f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.Directory]
    _json(spark, "", {n: fetch.tidied(f"{a.results_root.rstrip('/')}/{n}") for n in sorted(folders)})


def normalize_sources(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = curation.selected(tables.read_manifest(spark, a.manifest), a.limit or None, source_id=listed(a.source_ids))
    made = normalize.normalize(spark, rows, a.results_root, checkpoint=f"{a.output_root.rstrip('/')}/parsed")
    _json(spark, "", normalize.write(spark, made, a.output_root))


def plot_quality(spark: SparkSession, a: argparse.Namespace) -> None:
    """The tables behind the plots; nothing is drawn."""
    read = lambda n: spark.read.parquet(f"{a.normalized_root.rstrip('/')}/parquet/{n}")
    for name, df in reports.quality_tables(read("spectra_metadata"), read("source_summary"), a.top_n_sources).items():
        df.write.mode("overwrite").parquet(f"{(a.output_root or a.normalized_root).rstrip('/')}/quality/{name}")


def filter_coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda n: spark.read.parquet(f"{a.normalized_root.rstrip('/')}/parquet/{n}")
    names = ("spectra_metadata", "normalized_spectra", "source_summary")
    for name, df in zip(names, curation.by_coverage(*map(read, names), a.min_coverage)):
        df.write.mode("overwrite").parquet(f"{a.output_root.rstrip('/')}/parquet/{name}")


def build_package(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda n: spark.read.parquet(f"{a.normalized_root.rstrip('/')}/parquet/{n}")
    out = tables.read_manifest(spark, a.exclude_spectra_csv) if a.exclude_spectra_csv else None
    labels = tables.read_manifest(spark, a.labels)
    made = package.package(tables.read_manifest(spark, a.manifest), read("spectra_metadata"), read("normalized_spectra"), labels, a.exclude_source_id, out)
    _json(spark, "", package.write(spark, made, a.output_root, CANONICAL.start, CANONICAL.width, a.catalog or None))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="prismora")
    top.add_argument("--json-errors", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, required: str = "", **optional: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for flag in required.split():
            p.add_argument(f"--{flag}", required=True)
        for flag, default in optional.items():
            kind = {"type": type(default)} if isinstance(default, (int, float, str)) and not isinstance(default, bool) else {}
            p.add_argument(f"--{flag.replace('_', '-')}", default=list(default) if isinstance(default, list) else default, **({"action": "store_true"} if default is False else {"action": "append"} if isinstance(default, list) else kind))
        p.set_defaults(run=run)
        return p

    def settings(p: argparse.ArgumentParser) -> None:
        p.add_argument("--neighbor-estimator", choices=ESTIMATORS, default="mean")
        p.add_argument("--knn-backend", choices=BACKENDS, default="numpy")

    for name in ("build-mapping-library", "prepare-mapping-library"):
        p = add(name, build_library, "library-root srf-root output-root", dtype="float32")
        p.add_argument("--source-sensor", action="append", required=True)
        p.add_argument("--knn-index-backend", action="append", default=[], choices=ann.BACKENDS)
    add("download-prepared-library", download, "output-root url", sha256="", no_verify=False)
    shared = {"prepared_root": "", "target_sensor": "", "k": 10, "min_valid_bands": 1, "knn_eps": 0.0, "exclude_row_id": [], "exclude_sample_name": [], "diagnostics_output": "", "neighbor_review_output": ""}
    p = add("map-reflectance", map_one, "source-sensor input output", **shared)
    settings(p)
    p.add_argument("--output-mode", choices=MODES, required=True)
    p = add("map-reflectance-batch", map_batch, "source-sensor input output", **shared, self_exclude_sample_id=False)
    settings(p)
    p.add_argument("--output-mode", choices=MODES, required=True)
    p.add_argument("--output-format", choices=["csv", "zarr"], default="csv")
    p.add_argument("--output-chunk-size", type=int, default=None)
    settings(add("benchmark-mapping", benchmark_mapping, "source-sensor target-sensor report", prepared_root="", k=10, test_fraction=0.2, max_test_rows=0, random_seed=0, knn_eps=0.0))
    add("validate-prepared-library", validate_library, "prepared-root", no_verify_checksums=False)
    some = {"source_ids": "", "tiers": "", "statuses": "", "adapters": ""}
    add("plan-matrix", plan_matrix, "manifest", **some, limit=0, output="")
    fetching = {"user_agent": fetch.AGENT}
    add("fetch-source", fetch_source, "manifest source-id output-root", **fetching).add_argument("--fetch-mode", choices=["metadata", "assets"], default="metadata")
    add("fetch-batch", fetch_batch, "manifest output-root", **some, **fetching, continue_on_error=False).add_argument("--fetch-mode", choices=["metadata", "assets"], default="assets")
    add("assemble-database", assemble, "manifest results-root output-root")
    add("tidy-results", tidy, "results-root")
    add("normalize-sources", normalize_sources, "manifest results-root output-root", source_ids="", limit=0)
    add("plot-quality", plot_quality, "normalized-root", output_root="", top_n_sources=20)
    add("filter-coverage", filter_coverage, "normalized-root output-root", min_coverage=0.8)
    add("build-library-package", build_package, "manifest normalized-root labels output-root", exclude_source_id=[], exclude_spectra_csv="", catalog="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(spark or session(), args)
    except CodedError as e:
        print(json.dumps(e.as_dict(args.command), indent=2, sort_keys=True, default=str) if args.json_errors else f"{e.code}: {e.message}", file=sys.stderr)
        return 2
    return 0
