"""Land-cover classes of spectra by an ordered cascade of rules, and the clusters and outliers of a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPS = ("soil", "vegetation", "water", "urban")

# Sources, chapters, prefixes and words that name a class.
SOURCES = {
    "soil": "ossl bssl hsdos probefield_preprocessed probefield_aligned neospectra_soil_nir",
    "vegetation": "mediterranean_woodlands montesinho_plants ghisaconus_v001 ghisacasia_v001 emit_adjusted_vegetation",
    "urban": "german_urban_image_spectra brussels_image_urban_materials brussels_apex_2015_ground_truth hymap_2007_urban_ground_truth santa_barbara_urban_reflectance existing_urban_reference_data",
}
CHAPTERS = {"urban": "ChapterA_ArtificialMaterials ChapterC_Coatings", "soil": "ChapterS_SoilsAndMixtures", "vegetation": "ChapterV_Vegetation", "water": "ChapterL_Liquids"}
PREFIXES = {"urban": "manmade", "soil": "soil", "vegetation": "vegetation nonphotosyntheticvegetation", "water": "water"}
STEMS = {"vegetation": "filtered_veg", "water": "filtered_ocean surface_Liquids"}
WORDS = {
    "soil": "soil loam clay sand silt mud peat sediment dust",
    "vegetation": "veget leaf grass tree crop forest plant canopy pine oak needle shrub lichen moss woodland",
    "water": "water seawater ocean river lake pond snow ice liquid brine",
    "urban": "urban asphalt concrete brick roof road building metal paint glass cement fabric plaster paving shingle tile tar",
}
ROCKS = "basalt lava rock granite sandstone dolerite fragmental"
SHIFTED = "+1shf +1shft +const /shif unshf"
CHAPTER_MARK = "ASCIIdata_splib07b_cvASD/"


def metadata_map(c: Column) -> Column:
    """JSON object as a map of texts; anything else is an empty map, a null value an empty text."""
    read = F.from_json(c, "map<string,string>")
    return F.coalesce(F.transform_values(read, lambda k, v: F.coalesce(v, F.lit(""))), F.create_map().cast("map<string,string>"))


def _any(text: Column, words: str) -> Column:
    out = F.lit(False)
    for w in words.split():
        out = out | text.contains(w)
    return out


def _named(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for group, names in table.items():
        out = F.when(value.isin(names.split()), group).otherwise(out)
    return out


def classified(metadata: DataFrame, manifest: DataFrame) -> DataFrame:
    """metadata with landcover_group (null: none) and classification_rule; the first rule that speaks decides.

    metadata: source_id, input_path, sample_name, metadata_json; manifest: source_id, name, subsection, spectral_type.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    about = manifest.select("source_id", text("name").alias("_name"), text("subsection").alias("_sub"), text("spectral_type").alias("_type"))
    rows = metadata.join(about, "source_id", "left")
    for c in ("_name", "_sub", "_type"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    source, path, sample = F.col("source_id"), F.coalesce("input_path", F.lit("")), F.coalesce("sample_name", F.lit(""))
    none = F.lit(None).cast("string")
    verdict = lambda group, rule: F.struct(group.cast("string").alias("g"), rule.alias("r"))
    file = F.substring_index(path, "/", -1)
    level = F.lower(F.coalesce(F.element_at(metadata_map(F.col("metadata_json")), "level_1"), F.lit("")))
    chapter = F.substring_index(F.substring_index(path, CHAPTER_MARK, -1), "/", 1)
    prefix, stem = F.substring_index(file, ".", 1), F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    pure, own, pre, emitted = _named(source, SOURCES), _named(chapter, CHAPTERS), _named(prefix, PREFIXES), _named(stem, STEMS)
    whole = F.concat_ws(" ", F.col("_name"), F.col("_type"), F.lower(sample), F.lower(path))
    hits = F.array_compact(F.array(*[F.when(_any(whole, w), g) for g, w in WORDS.items()]))
    rules = [
        (source == "hyspiri_ground_targets", F.lit("soil"), F.lit("hyspiri:playa_dry_lake")),
        ((source == "drylands_emit") & (level == "soil"), F.lit("soil"), F.lit("drylands_emit:metadata_level_1=soil")),
        ((source == "drylands_emit") & (level == "pv"), F.lit("vegetation"), F.lit("drylands_emit:metadata_level_1=pv")),
        ((source == "drylands_emit") & (level == "npv"), none, F.lit("drylands_emit:metadata_level_1=npv")),
        ((source == "antarctic_vegetation_speclib") & _any(F.lower(F.concat_ws(" ", sample, path)), ROCKS), F.lit("soil"), F.lit("antarctic:rock_associated")),
        (pure.isNotNull(), pure, F.concat(F.lit("source:"), source)),
        ((source == "usgs_v7") & _any(F.lower(sample), SHIFTED), none, F.lit("usgs:perturbed_variant")),
        ((source == "usgs_v7") & own.isNotNull(), own, F.concat(F.lit("usgs:"), chapter)),
        ((source == "ecostress_v1") & pre.isNotNull(), pre, F.concat(F.lit("ecostress:"), prefix)),
        ((source == "emit_l2a_surface") & emitted.isNotNull(), emitted, F.concat(F.lit("emit:"), stem)),
        (F.col("_sub") == "soil", F.lit("soil"), F.concat(F.lit("subsection:"), F.col("_sub"))),
        (F.col("_sub").startswith("vegetation"), F.lit("vegetation"), F.concat(F.lit("subsection:"), F.col("_sub"))),
        ((F.col("_sub") == "urban") | F.col("_name").contains("urban"), F.lit("urban"), F.concat(F.lit("subsection_or_name:"), F.coalesce(F.nullif("_sub", F.lit("")), F.col("_name")))),
        (F.size(hits) == 1, F.get(hits, F.lit(0)), F.lit("keyword")),
    ]
    out = None
    for condition, group, rule in rules:
        c = F.coalesce(condition, F.lit(False))
        out = F.when(c, verdict(group, rule)) if out is None else out.when(c, verdict(group, rule))
    out = out.otherwise(verdict(none, F.lit("unclassified")))
    return rows.withColumn("_v", out).withColumn("landcover_group", F.col("_v.g")).withColumn("classification_rule", F.col("_v.r")).drop("_v", "_name", "_sub", "_type")


def group_summary(analyzed: DataFrame) -> DataFrame:
    """A row a class: spectra, sources, clusters, outliers and their rate."""
    return analyzed.groupBy("landcover_group").agg(
        F.count("*").alias("classified_spectra"), F.countDistinct("source_id").alias("source_count"), F.countDistinct("cluster_id").alias("cluster_count"), F.count_if("is_outlier").alias("flagged_outliers"), F.avg(F.col("is_outlier").cast("double")).alias("outlier_rate")
    )


def source_summary(analyzed: DataFrame) -> DataFrame:
    """A row a class and source: spectra, outliers, the largest score, the rate."""
    out = analyzed.groupBy("landcover_group", "source_id").agg(F.count("spectrum_id").alias("spectra"), F.count_if("is_outlier").alias("flagged_outliers"), F.max("outlier_score").alias("max_outlier_score"))
    return out.withColumn("outlier_rate", F.col("flagged_outliers") / F.col("spectra"))
