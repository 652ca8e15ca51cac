"""The library package: metadata, spectra and labels joined, exclusions audited, sources summarised, prototypes made.

Spectra are one array a row; `to_wide` and `from_wide` change to and from a column a wavelength for files.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PREPARE, CodedError
from ..operators import curves
from ..sources.files import write_text

KEYS = ["source_id", "spectrum_id", "sample_name"]
URBAN, URBAN_END = "urban", 2450.0  # urban prototypes need spectra that reach so far
GRID_SIZE = 2101


def from_wide(df: DataFrame, prefix: str = "nm_") -> DataFrame:
    """Key columns and `values` from a column a wavelength, in the order of the wavelengths."""
    names = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: float(c[len(prefix) :]))
    if not names:
        raise CodedError(PREPARE, "there are no wavelength columns", prefix=prefix)
    return df.select(*[c for c in df.columns if c not in names], F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("values"))


def to_wide(df: DataFrame, start: int, width: int, values: str = "values", prefix: str = "nm_") -> DataFrame:
    return df.select(*[c for c in df.columns if c != values], *[F.get(values, F.lit(i)).alias(f"{prefix}{start + i}") for i in range(width)])


def without(df: DataFrame, out: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are NOT IN `out`, whose keys are not null: a row with a null key stays only if `out` is empty."""
    if out.isEmpty():
        return df
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.join(out.select(*keys).distinct(), keys, "left_anti")


def package(manifest: DataFrame, metadata: DataFrame, spectra: DataFrame, labels: DataFrame, exclude_sources: Iterable[str] = (), exclude_spectra: DataFrame | None = None, grid_size: int = GRID_SIZE) -> dict[str, DataFrame]:
    """All tables by name.

    manifest: source_id, name, provider, tier, priority, ingest_role; metadata: keys, source_name, ingest_role,
    input_path, parser, native_*, normalized_points and so on; spectra: keys, values; labels: keys, landcover_group
    ("" is none), classification_rule; exclude_spectra: source_id, spectrum_id, reason.
    """
    spark = manifest.sparkSession
    names = sorted({s.strip() for s in exclude_sources if s and s.strip()})
    sources_out = spark.createDataFrame([(s,) for s in names], "source_id string")
    if exclude_spectra is None:
        spectra_out = spark.createDataFrame([], "source_id string, spectrum_id string, reason string")
    else:
        text = lambda c: F.col(c).cast("string").alias(c)
        spectra_out = exclude_spectra.select(text("source_id"), text("spectrum_id"), F.coalesce(F.col("reason").cast("string"), F.lit("")).alias("reason")).distinct()
        if not spectra_out.where("source_id is null or spectrum_id is null").isEmpty():
            raise CodedError(PREPARE, "excluded spectra need a source and a spectrum")
    labels = labels.select(*KEYS, F.nullif("landcover_group", F.lit("")).alias("landcover_group"), "classification_rule")
    share = F.col("normalized_points").cast("double") / F.lit(float(grid_size))
    available = metadata.groupBy("source_id").agg(
        F.count("*").alias("available_spectra_count"), F.avg(share).alias("available_mean_coverage_fraction"), F.min("native_min_nm").alias("available_min_native_nm"), F.max("native_max_nm").alias("available_max_native_nm")
    )

    def kept(df: DataFrame) -> DataFrame:
        return without(without(df, sources_out, ["source_id"]), spectra_out, ["source_id", "spectrum_id"])

    meta = kept(metadata).join(labels, KEYS, "left").withColumn("coverage_fraction", share)
    spec = kept(spectra).join(labels, KEYS, "left")
    ex = sources_out.select("source_id", F.lit(True).alias("_out"))
    wanted = metadata.select("source_id").union(sources_out.select("source_id")).distinct()
    msources = manifest.join(available, "source_id", "left").join(F.broadcast(ex), "source_id", "left").join(wanted, "source_id", "left_semi")
    msources = msources.withColumn("available_spectra_count", F.coalesce("available_spectra_count", F.lit(0))).withColumn("included_in_spectra", F.col("_out").isNull())
    msources = msources.withColumn("exclusion_reason", F.when(F.col("_out").isNotNull(), "excluded_by_source_id")).drop("_out")

    # one row a source before it meets the manifest
    own = meta.groupBy("source_id").agg(
        F.count("spectrum_id").alias("n"), F.count_if(F.col("landcover_group").isNotNull() & F.col("spectrum_id").isNotNull()).alias("labeled"), F.countDistinct("landcover_group").alias("groups"), F.sum("coverage_fraction").alias("cover"),
        F.count("coverage_fraction").alias("covered"), F.max("source_name").alias("source_name"), F.min("native_min_nm").alias("low"), F.max("native_max_nm").alias("high"),
    )
    n = F.coalesce(F.sum("n"), F.lit(0))
    summary = msources.join(own, "source_id", "left").groupBy("source_id").agg(
        F.coalesce(F.max("source_name"), F.max("name")).alias("source_name"), F.max("provider").alias("provider"), F.max("tier").alias("tier"), F.max("priority").alias("priority"), F.max("ingest_role").alias("manifest_ingest_role"),
        F.bool_or("included_in_spectra").alias("included_in_spectra"), F.max("available_spectra_count").alias("available_spectra_count"), n.alias("spectra_count"), F.greatest(F.max("available_spectra_count") - n, F.lit(0)).alias("excluded_spectra_count"),
        F.coalesce(F.sum("labeled"), F.lit(0)).alias("labeled_spectra_count"), (n - F.coalesce(F.sum("labeled"), F.lit(0))).alias("unlabeled_spectra_count"), F.coalesce(F.max("groups"), F.lit(0)).alias("landcover_group_count"),
        F.when(n > 0, F.sum("cover") / F.sum("covered")).otherwise(F.max("available_mean_coverage_fraction")).alias("mean_coverage_fraction"),
        F.coalesce(F.min("low"), F.max("available_min_native_nm")).alias("min_native_nm"), F.coalesce(F.max("high"), F.max("available_max_native_nm")).alias("max_native_nm"), F.max("exclusion_reason").alias("exclusion_reason"),
    )
    gone = msources.where("not included_in_spectra").select(
        "source_id", F.coalesce("name", "source_id").alias("source_name"), "provider", "tier", "priority", F.col("ingest_role").alias("manifest_ingest_role"), "available_spectra_count", "available_mean_coverage_fraction",
        F.col("available_min_native_nm").alias("min_native_nm"), F.col("available_max_native_nm").alias("max_native_nm"), "exclusion_reason",
    )
    two = ["source_id", "spectrum_id"]
    audit = without(spectra_out, sources_out, ["source_id"])
    audit = audit.join(metadata.select(*two, "source_name", "sample_name", "input_path", "parser", "native_min_nm", "native_max_nm", "value_scale_applied"), two, "left")
    audit = audit.join(labels.select(*two, "landcover_group", "classification_rule"), two, "left").withColumnRenamed("reason", "exclusion_reason")
    labeled = F.col("landcover_group").isNotNull()
    covers = meta.where(labeled).groupBy("landcover_group").agg(F.count("*").alias("spectra_count"), F.countDistinct("source_id").alias("source_count"), F.avg("coverage_fraction").alias("mean_coverage_fraction"))
    eligible = meta.where(labeled & ((F.col("landcover_group") != URBAN) | (F.col("native_max_nm") >= URBAN_END)))
    joined = meta.join(spec.select(*KEYS, "values"), KEYS)
    return {
        "manifest_sources": msources, "spectra_metadata": meta, "normalized_spectra": spec, "spectra": joined, "labeled_spectra": joined.where(labeled), "source_summary": summary, "excluded_sources": gone, "excluded_spectra": audit,
        "landcover_summary": covers, "prototype_eligible_metadata": eligible, "landcover_prototypes": prototypes(joined.where(labeled), eligible.select(*KEYS).join(joined, KEYS)),
    }


def prototypes(labeled: DataFrame, eligible: DataFrame) -> DataFrame:
    """Mean curves by group and source (of all labelled spectra), pooled and source-balanced (of the eligible ones)."""
    by = ["landcover_group", "source_id"]
    names = labeled.groupBy(*by).agg(F.min("source_name").alias("source_name"))
    mean = F.zip_with("sums", "counts", lambda s, c: F.when(c > 0, s / c))
    own = curves.sums(labeled, by).join(names, by).select(F.lit("source").alias("prototype_level"), *by, "source_name", F.col("rows").alias("spectra_count"), F.lit(1).cast("long").alias("source_count"), mean.alias("values"))
    best = curves.sums(eligible, by)
    points = curves.long(best, *by)
    sizes = best.groupBy("landcover_group").agg(F.sum("rows").alias("spectra_count"), F.count("*").alias("source_count"))
    none = F.lit(None).cast("string")

    def level(name: str, curve: DataFrame) -> DataFrame:
        arrays = curve.groupBy("landcover_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("values"))
        return sizes.join(arrays, "landcover_group").select(F.lit(name).alias("prototype_level"), "landcover_group", none.alias("source_id"), none.alias("source_name"), "spectra_count", "source_count", "values")

    return level("pooled", curves.pooled(points, "landcover_group")).unionByName(level("source_balanced", curves.balanced(points, "landcover_group"))).unionByName(own)


def counts(tables: dict[str, DataFrame]) -> dict[str, object]:
    """The numbers of the build summary; individual exclusions and those of whole sources are added up."""
    meta, gone = tables["spectra_metadata"], tables["excluded_sources"]
    labeled = F.col("landcover_group").isNotNull()
    m = meta.agg(F.count("*"), F.count_if(labeled), F.countDistinct("source_id"), F.countDistinct(F.when(labeled, F.col("source_id")))).first()
    g = gone.agg(F.count("*"), F.coalesce(F.sum("available_spectra_count"), F.lit(0))).first()
    single = tables["excluded_spectra"].count()
    covers = {r[0]: r[1] for r in tables["landcover_summary"].select("landcover_group", "spectra_count").orderBy("landcover_group").collect()}  # a row a group
    return {
        "total_spectra": m[0], "classified_spectra": m[1], "unlabeled_spectra": m[0] - m[1], "source_count": tables["source_summary"].count(), "spectra_source_count": m[2], "labeled_source_count": m[3], "excluded_source_count": g[0],
        "excluded_individual_spectra_count": single, "excluded_spectra_count": g[1] + single, "landcover_group_count": len(covers), "landcover_counts": covers, "prototype_rows": tables["landcover_prototypes"].count(),
    }


def write(spark: SparkSession, tables: dict[str, DataFrame], path: str, start: int, width: int, catalog: str | None = None) -> dict[str, object]:
    """Parquet and wide CSV of every table, a grid table and build_summary.json; `catalog`: also tables of that database."""
    grid = spark.range(width).select((F.col("id") + start).cast("double").alias("wavelength_nm"), F.concat(F.lit("nm_"), (F.col("id") + start).cast("string")).alias("column_name"))
    if catalog:
        spark.sql(f"create database if not exists `{catalog}`")
    for name, df in (tables | {"wavelength_grid": grid}).items():
        df.write.mode("overwrite").parquet(f"{path}/parquet/{name}")
        flat = to_wide(df, start, width) if "values" in df.columns else df
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/tabular/{name}")
        if catalog:
            df.write.mode("overwrite").saveAsTable(f"`{catalog}`.`{name}`")
        else:
            spark.read.parquet(f"{path}/parquet/{name}").createOrReplaceTempView(name)
    done = counts(tables)
    write_text(spark, f"{path}/build_summary.json", json.dumps(done, sort_keys=True, indent=2))
    return done
