"""The catalogue of sources and what was fetched of them: three tables, a status view and a summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import status_counts
from ..sources.files import write_text

FETCH = "source_id string, source_name string, fetch_adapter string, fetch_mode string, status string, landing_url string, started_at string, finished_at string, notes array<string>, artifacts array<struct<artifact_id:string,kind:string,url:string,path:string,media_type:string,size_bytes:long,sha256:string,status:string,note:string>>"
ARTIFACT = ("artifact_id", "kind", "url", "path", "media_type", "size_bytes", "sha256", "status", "note")


def fetched(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(fetch_results, artifacts) of every fetch-result.json under the root."""
    files = spark.read.schema(FETCH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "fetch-result.json").json(root)
    results = files.drop("artifacts").withColumn("notes", F.array_join(F.coalesce("notes", F.array().cast("array<string>")), " | "))
    one = files.select("source_id", F.explode("artifacts").alias("a"))
    blank = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0).cast("long") if c == "size_bytes" else F.lit("")).alias(c)
    return results, one.select("source_id", *[blank(c) for c in ARTIFACT])


def status_view(sources: DataFrame, results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A row a source and fetch status with its number of artifacts, which are counted before they meet the sources."""
    counted = artifacts.groupBy("source_id").agg(F.count("artifact_id").alias("n"))
    fetch = results.select("source_id", F.col("status").alias("_status"), F.col("fetch_mode").alias("_mode"))
    rows = sources.select("source_id", "name", "tier", F.col("status").alias("manifest_status"), "fetch_adapter").join(fetch, "source_id", "left").join(counted, "source_id", "left")
    rows = rows.withColumn("fetch_status", F.coalesce("_status", F.lit("not_fetched"))).withColumn("fetch_mode", F.coalesce("_mode", F.lit("")))
    return rows.groupBy("source_id", "name", "tier", "manifest_status", "fetch_adapter", "fetch_status", "fetch_mode").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("artifact_count"))


def assemble(spark: SparkSession, manifest: DataFrame, results_root: str, path: str) -> dict[str, object]:
    """Write sources, fetch_results, artifacts (CSV and Parquet) and the view, and build_summary.json; the summary."""
    results, artifacts = fetched(spark, results_root)
    tables = {"sources": manifest, "fetch_results": results, "artifacts": artifacts, "source_build_status": status_view(manifest, results, artifacts)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/parquet/{name}")
        df.write.mode("overwrite").option("header", True).csv(f"{path}/tabular/{name}")
        spark.read.parquet(f"{path}/parquet/{name}").createOrReplaceTempView(name)
    counts = lambda df: {r["status"]: r["n"] for r in status_counts(df).collect()}  # noqa: E731  # a row a status
    done = {"manifest_sources": manifest.count(), "fetched_sources": results.count(), "artifact_rows": artifacts.count(), "manifest_status_counts": counts(manifest), "fetch_status_counts": counts(results)}
    write_text(spark, f"{path}/build_summary.json", json.dumps(done, sort_keys=True, indent=2))
    return done
