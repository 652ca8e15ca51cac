"""Curation of normalised tables: selections, filters, rule-based exclusions, merging of roots and rebuilt summaries.

Tables: metadata (source_id, spectrum_id, source_name, ingest_role, parser, native_*, normalized_points, ...), spectra
(source_id, spectrum_id, sample_name, values), summary (a row a source with its failure_count), failures.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PREPARE, CodedError

KEY = ["source_id", "spectrum_id"]
GRID_POINTS = 2101

# The curated rules.
SUBSET_RULES = [
    {"name": "exclude_bssl_longwave_only_subset", "source_id": "bssl", "native_min_nm_min": 600.0, "native_spacing_nm_min": 5.0, "reason": "bssl 600-3000 nm 5 nm subset creates a false onset at 600 nm in pooled soil means"},
]
DROPPED_SOURCE = "existing_urban_reference_data"
PARTIAL_SOIL = ("ossl", "soil", 452.0)
GAP_FILLED = ("ghisaconus_v001", "vegetation", 400, 499)
RESCALED = ("santa_barbara_urban_reflectance", 1.0, 10000.0)
EXCLUDED_NOTE = "Excluded from curated merged database due to unstable visible-band behavior."


def selected(manifest: DataFrame, limit: int | None = None, order: str = "source_id", **wanted: Iterable[str]) -> DataFrame:
    """Rows whose columns are among the wanted values; an empty list is no condition. limit: the first by `order`."""
    for name, values in wanted.items():
        given = [v for v in values or [] if v]
        if given:
            manifest = manifest.where(F.col(name).isin(given))
    return manifest.orderBy(order).limit(limit) if limit is not None else manifest


def parsers(metadata: DataFrame, mark: str = ",") -> DataFrame:
    """source_id, normalized_spectra, parsers: sorted name:count."""
    n = metadata.groupBy("source_id", F.coalesce("parser", F.lit("unknown")).alias("parser")).agg(F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("parser", "n"))), lambda s: F.concat_ws(":", s["parser"], s["n"].cast("string")))
    return n.groupBy("source_id").agg(F.sum("n").alias("normalized_spectra"), F.array_join(text, mark).alias("parsers"))


def rebuilt_summary(summary: DataFrame, metadata: DataFrame, drop_empty: bool = False) -> DataFrame:
    """The summary with counts and parsers of the metadata that is left; failure counts stay."""
    base = summary.drop("normalized_spectra", "parsers").withColumn("failure_count", F.coalesce(F.col("failure_count").cast("long"), F.lit(0)))
    out = base.join(parsers(metadata), "source_id", "left")
    out = out.withColumn("normalized_spectra", F.coalesce("normalized_spectra", F.lit(0))).withColumn("parsers", F.coalesce("parsers", F.lit("")))
    return out.where("normalized_spectra > 0") if drop_empty else out


def of_rows(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of another table that belong to rows of the metadata."""
    return df.join(metadata.select(*KEY).distinct(), KEY, "left_semi")


def by_coverage(metadata: DataFrame, spectra: DataFrame, summary: DataFrame, least: float = 0.8, points: int = GRID_POINTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, spectra, summary) of spectra that cover the share `least` of the grid or more."""
    if not 0 <= least <= 1:
        raise CodedError(PREPARE, "the coverage is between 0 and 1", min_coverage=least)
    kept = metadata.where(F.col("normalized_points").try_cast("double") / points >= least)
    return kept, of_rows(spectra, kept), rebuilt_summary(summary, kept)


def by_native_range(metadata: DataFrame, start: float = 410.0, end: float = 2400.0) -> tuple[DataFrame, DataFrame]:
    """(metadata of spectra that begin by `start` and reach `end`, source_id, total, kept, dropped, kept_fraction)."""
    keep = F.coalesce((F.col("native_min_nm") <= start) & (F.col("native_max_nm") >= end), F.lit(False))
    return metadata.where(keep), kept_by_source(metadata, keep)


def kept_by_source(metadata: DataFrame, keep: Column) -> DataFrame:
    out = metadata.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"))
    return out.withColumn("dropped", F.col("total") - F.col("kept")).withColumn("kept_fraction", F.col("kept") / F.col("total"))


def rule_condition(rule: Mapping[str, object]) -> Column:
    """source_id equal, and columns named in <column>_min at least their value."""
    out = F.col("source_id") == F.lit(str(rule["source_id"]))
    for name, value in rule.items():
        if name.endswith("_min") and name != "native_min_nm":
            out = out & (F.col(name.removesuffix("_min")).try_cast("double") >= float(value))
    return F.coalesce(out, F.lit(False))


def by_rules(metadata: DataFrame, rules: Sequence[Mapping[str, object]] = SUBSET_RULES) -> dict[str, DataFrame]:
    """retained: metadata that no rule hits; excluded: a row per rule and spectrum that it hits; by_source; by_rule."""
    hits = [rule_condition(r) for r in rules]
    hit = reduce(lambda a, b: a | b, hits, F.lit(False))
    named = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(str(r["name"])).alias("rule_name"), F.lit(str(r["reason"])).alias("exclusion_reason"))) for h, r in zip(hits, rules)]))
    excluded = metadata.where(hit).withColumn("_rule", F.explode(named)).select(*metadata.columns, "_rule.*")
    by_source = kept_by_source(metadata, ~hit).select("source_id", "total", F.col("dropped").alias("excluded"), F.col("kept").alias("retained"), (F.col("dropped") / F.col("total")).alias("excluded_fraction"))
    by_rule = excluded.groupBy("rule_name", "source_id").agg(F.countDistinct("spectrum_id").alias("excluded_spectra"))
    return {"retained": metadata.where(~hit), "excluded": excluded, "by_source": by_source, "by_rule": by_rule}


def by_source_rules(metadata: DataFrame, labels: DataFrame, spectra: DataFrame, donors: DataFrame, start: int = 400) -> tuple[DataFrame, DataFrame]:
    """(metadata, spectra): one source dropped, soil that starts late in another dropped, a third's blue end taken from
    `donors` (spectra of the repaired set) where that is whole, a fourth rescaled. start: the grid's first wavelength."""
    frame = metadata.join(labels.select(*KEY, "landcover_group"), KEY, "left")
    source, group, low = PARTIAL_SOIL
    gone = (F.col("source_id") == DROPPED_SOURCE) | ((F.col("source_id") == source) & (F.col("landcover_group") == group) & (F.col("native_min_nm") >= low))
    frame = frame.where(~F.coalesce(gone, F.lit(False)))
    name, old, factor = RESCALED
    rescale = F.coalesce((F.col("source_id") == name) & (F.col("value_scale_applied") == old), F.lit(False))
    fill_source, fill_group, lo, hi = GAP_FILLED
    fill = F.coalesce((F.col("source_id") == fill_source) & (F.col("landcover_group") == fill_group), F.lit(False))
    marks = frame.select(*KEY, rescale.alias("_rescale"), fill.alias("_fill")).groupBy(*KEY).agg(F.bool_or("_rescale").alias("_rescale"), F.bool_or("_fill").alias("_fill"))
    at, n = lo - start, hi - lo + 1
    part = F.slice("values", at + 1, n)
    whole = F.forall(part, lambda v: v.isNotNull() & ~F.isnan(v))
    given = donors.where((F.col("source_id") == fill_source) & whole).select(*KEY, part.alias("_blue"))
    rows = spectra.join(marks, KEY).join(given, KEY, "left")
    size = F.size("values")
    filled = F.concat(F.slice("values", 1, at), F.col("_blue"), F.slice("values", at + n + 1, F.greatest(size - at - n, F.lit(0))))
    values = F.when(F.col("_fill") & F.col("_blue").isNotNull(), filled).when(F.col("_rescale"), F.transform("values", lambda v: v / factor)).otherwise(F.col("values"))
    kept = frame.withColumn("value_scale_applied", F.when(rescale, factor).otherwise(F.col("value_scale_applied"))).drop("landcover_group")
    return kept, rows.withColumn("values", values).select(*spectra.columns)


def without_sources(tables: Mapping[str, DataFrame], sources: Iterable[str]) -> dict[str, DataFrame]:
    """Every table that has source_id without the rows of some sources; others as they are."""
    names = sorted({s.strip() for s in sources if s.strip()})
    return {k: df.where(~F.coalesce(F.col("source_id").cast("string").isin(names), F.lit(False))) if names and "source_id" in df.columns else df for k, df in tables.items()}


def annotated(manifest: DataFrame, sources: Iterable[str], note: str = EXCLUDED_NOTE) -> DataFrame:
    """The manifest with the note added to those sources' notes."""
    notes = F.coalesce("notes", F.lit(""))
    added = F.when(notes == "", F.lit(note)).otherwise(F.concat_ws(" ", notes, F.lit(note)))
    return manifest.withColumn("notes", F.when(F.col("source_id").isin(list(sources)), added).otherwise(notes))


def merged(roots: Sequence[DataFrame], key: Sequence[str] | None = KEY) -> tuple[DataFrame, DataFrame]:
    """(rows, duplicates): roots of equal columns one after another; of rows with one key the first root's first stays.

    A row's place is its partition and its place there, from one evaluation: a root dealt by sampled ranges has other
    partitions the next time.
    """
    head = roots[0].columns
    if any(r.columns != head for r in roots):
        raise CodedError(PREPARE, "the roots' columns differ", columns=[r.columns for r in roots])
    numbered = [r.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_root", F.lit(k)) for k, r in enumerate(roots)]
    rows = reduce(DataFrame.unionByName, numbered)
    if not key:
        return rows.select(*head), rows.limit(0).select(*head)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_root", "_pos"))
    rows = rows.withColumn("_nth", nth)
    return rows.where("_nth = 1").select(*head), rows.where("_nth > 1").select(*head)


def merged_summary(metadata: DataFrame, failures: DataFrame) -> DataFrame:
    """A row a source of merged metadata: name and role of its least spectrum_id, failures, spectra, parsers."""
    about = metadata.groupBy("source_id").agg(F.min_by("source_name", "spectrum_id").alias("source_name"), F.min_by("ingest_role", "spectrum_id").alias("ingest_role"))
    failed = failures.groupBy("source_id").agg(F.count("*").alias("failure_count"))
    out = about.join(failed, "source_id", "left").join(parsers(metadata), "source_id", "left")
    return out.select("source_id", "source_name", "ingest_role", F.coalesce("failure_count", F.lit(0)).alias("failure_count"), F.coalesce("normalized_spectra", F.lit(0)).alias("normalized_spectra"), F.coalesce("parsers", F.lit("")).alias("parsers"))


def sampled(df: DataFrame, by: Sequence[str], n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """`n` rows of each group, the least by a seeded hash of their key: the same rows on each run and any partitioning."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit(seed)), *key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def contiguous(df: DataFrame, key: str, position: str) -> DataFrame:
    """key and the number of runs of its rows by position: 1 where they stand together."""
    w = Window.orderBy(position)
    starts = df.withColumn("_new", F.coalesce(F.lag(key).over(w) != F.col(key), F.lit(True)))
    return starts.groupBy(key).agg(F.count_if("_new").alias("runs"))


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
