"""Raw source files to normalised tables: every file is parsed in one task, spectra are cleaned and put on the grid.

Files are read by Spark's binaryFile source, so any store works. A file that can't be read, or holds no spectrum, is a
failure row; a spectrum that can't be normalised is one too. Files of no bytes are passed over by the file source and
leave no row. Headers of binary libraries meet their data by a join.
"""

from __future__ import annotations

import io
import json
import math
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import CANONICAL, Grid
from . import binary_spectra as B
from . import text_spectra as T
from .files import write_text

SCHEMA = "input_path string, parser string, sample_name string, wavelengths_nm array<double>, values array<double>, metadata map<string,string>, value_scale_hint double, reason string"
TEXT = (".txt", ".tab", ".csv")

# How files are ordered, skipped and refused.
PRIORITY = {".hdr": 0, ".zip": 1, ".xlsx": 2, ".xls": 2, ".rds": 2, ".nc": 2, ".txt": 3, ".tab": 4, ".csv": 5, ".sli": 6}
PREFERRED = ("spectra", "spectrum", "reflectance", "refl", "rrs")
ANCILLARY = ("metadata", "quality", "readme", "license", "information")
MEMBERS = (".csv", ".txt", ".tab", ".nc", ".zip")
RECORD_SOURCE = "usgs_v7"
AUXILIARY_PATHS = ("/errorbars/", "errorbars_for_", "wavelengths_asd", "bandpass")
ONLY = {"cabo_leaf_v2": "ref_spec.csv"}
NEVER = {"branch_tree_spectra_boreal_temperate": "sampled_tree_descriptions.csv", "understory_icos_europe": "pisek_et_al_2021_bg_table1.csv"}


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[1] if "." in name.lstrip(".") else ""


def skipped(source: str, path: str) -> bool:
    """Is the file no spectrum by what is known of its source?"""
    name, near = path.rsplit("/", 1)[-1].lower(), "/".join(path.lower().split("/")[-4:])
    if source == RECORD_SOURCE and (any(t in near for t in AUXILIARY_PATHS) or near.endswith("/errorbars")):
        return True
    return suffix(path) == ".csv" and (name != ONLY.get(source, name) or name == NEVER.get(source))


def archive(path: str, content: bytes, source: str, axis: list[float] | None = None) -> Iterator[tuple[str, T.Spectrum]]:
    """(member's path, spectrum) of an archive and those inside it, members with telling names first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if source == RECORD_SOURCE and axis is None:
            own = next((n for n in names if n.lower().endswith(".txt") and "wavelengths_asd" in n.lower()), None)
            axis = T.archive_axis(T.decoded(z.read(own)).splitlines()) if own else None
        telling = lambda n: any(t in n.lower() for t in PREFERRED)
        for n in sorted(names, key=lambda n: (not telling(n), n.lower())):
            low, file = n.lower(), n.rsplit("/", 1)[-1]
            if n.endswith("/") or file.startswith(".") or n.split("/")[0] == "__MACOSX" or low.endswith(".metadata.csv") or suffix(n) not in MEMBERS:
                continue
            if source == RECORD_SOURCE and (any(t in low for t in (*AUXILIARY_PATHS, "fwhm")) or low.endswith("/errorbars")):
                continue
            if any(t in low for t in ANCILLARY) and not telling(n):
                continue
            at, data = f"{path}::{n}", z.read(n)
            if suffix(n) == ".zip":
                yield from archive(at, data, source, axis)
            else:
                yield from ((at, s) for s in of_file(at, data, source, axis))


def of_file(path: str, content: bytes, source: str = "", axis: list[float] | None = None) -> list[T.Spectrum]:
    """Spectra of one file that is no archive and no header."""
    kind = suffix(path)
    if kind in TEXT:
        lines = T.decoded(content).splitlines()
        if source == RECORD_SOURCE and kind == ".txt" and "::" in path:
            return T.bare_values(lines, T.stem_of(path), axis)
        return T.textual(lines, path, source, axis)
    if kind in (".xlsx", ".xls"):
        return B.spreadsheet(content, source, path)
    if kind == ".rds":
        return B.data_frame(content, source, path)
    if kind == ".nc":
        return B.netcdf(content, path)
    raise LookupError(f"unsupported file type {kind or '[no suffix]'}")


def _parsed(path: str, content: bytes, source: str, data: bytes | None, data_path: str | None) -> Iterator[tuple]:
    """(path, spectrum) rows, or one (path, None, parser, stage, reason) row."""
    found = 0
    try:
        if suffix(path) == ".zip":
            given = archive(path, content, source)
        elif suffix(path) == ".hdr":
            if data is None:
                raise FileNotFoundError(f"could not resolve ENVI binary companion for {path.rsplit('/', 1)[-1]}")
            given = ((path, s) for s in B.envi(B.envi_header(content), data, path, data_path))
        else:
            given = ((path, s) for s in of_file(path, content, source))
        for at, s in given:
            found += 1
            yield f"{at}::{s.part}" if s.part else at, s, None, None, None
        if not found:
            yield path, None, "file_parse", "parse", "no spectra detected"
    except LookupError as e:
        yield path, None, "file_dispatch", "dispatch", str(e.args[0] if e.args else e)
    except Exception as e:  # whatever a damaged file raises is its failure row
        yield path, None, "file_parse", "parse", str(e)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def _with_companions(files: DataFrame) -> DataFrame:
    """files with data and data_path of headers; data files of headers are left out."""
    low = F.lower(F.substring_index("path", "/", -1))
    heads = files.where(low.endswith(".hdr"))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(p, q, k) for p, c in zip(d["path"], d["content"]) for k, q in enumerate(B.envi_companions(p, B.envi_header(bytes(c))))]
            yield pd.DataFrame(rows, columns=["head", "data_path", "nth"])

    asked = heads.mapInPandas(wanted, "head string, data_path string, nth int")
    there = asked.join(files.select(F.col("path").alias("data_path")), "data_path", "left_semi")
    best = there.groupBy("head").agg(F.min_by("data_path", "nth").alias("data_path"))
    plain = files.join(best.select(F.col("data_path").alias("path")), "path", "left_anti")
    data = files.select(F.col("path").alias("data_path"), F.col("content").alias("data")).join(best, "data_path")
    return plain.join(data.select(F.col("head").alias("path"), "data_path", "data"), "path", "left")


def read_spectra(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """Columns of SCHEMA for every file under the path; `reason` is set where a file gave no spectrum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for d in batches:
            for r in d.itertuples(index=False):
                rows = [(at, s.parser, s.sample_name, s.wavelengths_nm, s.values, s.metadata, s.value_scale_hint, None) if s else (at, None, None, None, None, None, None, why) for at, s, _, _, why in _parsed(r.path, bytes(r.content), source, None if r.data is None else bytes(r.data), r.data_path)]
                yield pd.DataFrame(rows, columns=names)

    return _with_companions(_files(spark, path)).select("path", "content", "data", "data_path").mapInPandas(run, SCHEMA)


def resampled(w: list[float], v: list[float], grid: np.ndarray) -> np.ndarray:
    """Linear on the grid, knots as they are, NaN outside the native range."""
    y = np.interp(grid, w, v)
    return np.where((grid < w[0]) | (grid > w[-1]), np.nan, y)


def on_grid(spectra: DataFrame, low: int = 400, high: int = 2500) -> DataFrame:
    """input_path, sample_name, values on the 1 nm grid (null outside the native range), normalized_points.

    Pairs that aren't finite go, of equal wavelengths the last value stays, values are divided by their scale.
    Spectra with fewer than two wavelengths are dropped.
    """
    grid = np.arange(low, high + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for path, name, w, v, hint in d.itertuples(index=False):
                try:
                    x, y, _ = T.clean(w, v, None if pd.isna(hint) else hint)
                except ValueError:
                    continue
                made = resampled(x, y, grid)
                out.append((path, name, [None if math.isnan(a) else float(a) for a in made], int(np.isfinite(made).sum())))
            yield pd.DataFrame(out, columns=["input_path", "sample_name", "values", "normalized_points"])

    known = spectra.where("reason is null").select("input_path", "sample_name", "wavelengths_nm", "values", "value_scale_hint")
    return known.mapInPandas(run, "input_path string, sample_name string, values array<double>, normalized_points long")


_ROW = (
    "source_id string, priority int, path string, nth int, input_path string, parser string, sample_name string, native_wavelength_count long, native_min_nm double, native_max_nm double, native_spacing_nm double, value_scale_applied double,"
    " normalized_points long, metadata_json string, values array<double>, stage string, reason string"
)


def normalize(spark: SparkSession, manifest: DataFrame, root: str, grid: Grid = CANONICAL, checkpoint: str | None = None) -> dict[str, DataFrame]:
    """spectra_metadata, normalized_spectra, normalization_failures, source_summary of the downloaded sources.

    checkpoint: a new folder for the parsed rows, so that files are parsed once and not for each table.

    manifest: source_id, name, ingest_role. root: a folder per source with fetch-result.json (status downloaded), its
    files in data/ or beside it. Spectra are numbered per source by file priority, path and place in the file.
    """
    results = spark.read.schema("source_id string, status string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "fetch-result.json").json(root)
    wanted = manifest.join(results.where("status = 'downloaded'").select("source_id").distinct(), "source_id", "left_semi").select("source_id", F.col("name").alias("source_name"), "ingest_role")
    base = root.rstrip("/")
    tail = F.substring_index(F.regexp_replace("path", r"^file:/+", "/"), base.removeprefix("file://").rstrip("/") + "/", -1)
    files = _with_companions(_files(spark, root)).withColumn("_tail", tail).withColumn("source_id", F.substring_index("_tail", "/", 1))
    parts = F.split("_tail", "/")
    name = F.substring_index("path", "/", -1)
    beside = F.size(parts) == 2
    own = beside | (F.get(parts, F.lit(1)) == "data")
    files = files.where(own & (name != "fetch-result.json") & ~(beside & name.startswith("."))).join(F.broadcast(wanted.select("source_id")), "source_id", "left_semi")
    wave = grid.wavelengths.astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_id", "priority", "path", "nth", "input_path", "parser", "sample_name", "native_wavelength_count", "native_min_nm", "native_max_nm", "native_spacing_nm", "value_scale_applied", "normalized_points", "metadata_json", "values", "stage", "reason"]
        none = (None,) * 9
        for d in batches:
            for r in d.itertuples(index=False):
                if skipped(r.source_id, r.path) or (suffix(r.path) == ".sli"):
                    continue
                head, rows = (r.source_id, PRIORITY.get(suffix(r.path), 7), r.path), []
                for nth, (at, s, parser, stage, why) in enumerate(_parsed(r.path, bytes(r.content), r.source_id, None if r.data is None else bytes(r.data), r.data_path)):
                    if s is None:
                        rows.append((*head, nth, at, parser, *none, stage, why))
                        continue
                    try:
                        x, y, scale = T.clean(s.wavelengths_nm, s.values, s.value_scale_hint)
                    except ValueError as e:
                        rows.append((*head, nth, at, s.parser, *none, "normalize", str(e)))
                        continue
                    made = resampled(x, y, wave)
                    values = [None if math.isnan(a) else float(a) for a in made]
                    rows.append((*head, nth, at, s.parser, s.sample_name, len(x), min(x), max(x), T.median_spacing(x), scale, int(np.isfinite(made).sum()), json.dumps(s.metadata, sort_keys=True), values, None, None))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    rows = files.select("source_id", "path", "content", "data", "data_path").mapInPandas(run, _ROW)
    if checkpoint:  # parse once: the tables below all come from these rows
        rows.write.parquet(checkpoint)
        rows = spark.read.parquet(checkpoint)
    good = rows.where("reason is null")
    # a number in its source: the files before it, counted a file, and its place in its own file
    counts = good.groupBy("source_id", "priority", "path").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_id").orderBy("priority", "path").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source_id", "path", "base")
    place = F.row_number().over(Window.partitionBy("source_id", "path").orderBy("nth"))
    numbered = good.withColumn("_place", place).join(bases, ["source_id", "path"]).withColumn("spectrum_id", F.format_string("%s_%06d", F.col("source_id"), F.col("base") + F.col("_place"))).join(F.broadcast(wanted), "source_id")
    failed = rows.where("reason is not null").select("source_id", "input_path", "parser", "stage", "reason")
    scanned = files.select("source_id").distinct()
    missing = wanted.join(scanned, "source_id", "left_anti").select("source_id", F.concat_ws("/", F.lit(base), F.col("source_id")).alias("input_path"), F.lit("source_scan").alias("parser"), F.lit("scan").alias("stage"), F.lit("missing data directory").alias("reason"))
    failures = failed.unionByName(missing)
    about = ["source_id", "source_name", "ingest_role", "spectrum_id", "sample_name", "input_path", "parser", "native_wavelength_count", "native_min_nm", "native_max_nm", "native_spacing_nm", "value_scale_applied", "normalized_points", "metadata_json"]
    metadata = numbered.select(*about)
    return {"spectra_metadata": metadata, "normalized_spectra": numbered.select("source_id", "spectrum_id", "sample_name", "values"), "normalization_failures": failures, "source_summary": source_summary(wanted, metadata, failures)}


def source_summary(sources: DataFrame, metadata: DataFrame, failures: DataFrame) -> DataFrame:
    """A row a source: spectra, failures, and its parsers as sorted name:count."""
    n = metadata.groupBy("source_id", "parser").agg(F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("parser", "n"))), lambda s: F.concat_ws(":", s["parser"], s["n"].cast("string")))
    parsers = n.groupBy("source_id").agg(F.sum("n").alias("normalized_spectra"), F.array_join(text, " | ").alias("parsers"))
    failed = failures.groupBy("source_id").agg(F.count("*").alias("failure_count"))
    out = sources.join(parsers, "source_id", "left").join(failed, "source_id", "left")
    return out.select("source_id", "source_name", "ingest_role", F.coalesce("normalized_spectra", F.lit(0)).alias("normalized_spectra"), F.coalesce("failure_count", F.lit(0)).alias("failure_count"), F.coalesce("parsers", F.lit("")).alias("parsers"))


def write(spark: SparkSession, tables: dict[str, DataFrame], path: str, grid: Grid = CANONICAL) -> dict[str, object]:
    """Parquet of every table and the grid, and build_summary.json."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/parquet/{name}")
    spark.range(grid.width).select((F.col("id") + grid.start).cast("double").alias("wavelength_nm"), F.concat(F.lit("nm_"), (F.col("id") + grid.start).cast("string")).alias("column_name")).write.mode("overwrite").parquet(f"{path}/parquet/wavelength_grid")
    read = lambda n: spark.read.parquet(f"{path}/parquet/{n}")
    s = read("source_summary").agg(F.count("*"), F.count_if(F.col("normalized_spectra") > 0), F.sum("normalized_spectra"), F.sum("failure_count")).first()
    parsers = {r["parser"]: r["count"] for r in read("spectra_metadata").groupBy("parser").count().orderBy("parser").collect()}
    done = {"downloaded_sources": s[0], "normalized_sources": s[1], "normalized_spectra": s[2] or 0, "failure_rows": s[3] or 0, "target_start_nm": grid.start, "target_end_nm": grid.end, "target_step_nm": 1, "parser_counts": parsers}
    write_text(spark, f"{path}/build_summary.json", json.dumps(done, sort_keys=True, indent=2))
    return done
