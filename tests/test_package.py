"""The packaging fixture, curation of small tables, the source catalogue, reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismora.errors import CodedError
from prismora.operators import curation, landcover
from prismora.plans import package, rebuild, reports, source_catalogue

META = "source_id string, source_name string, ingest_role string, spectrum_id string, sample_name string, input_path string, parser string, native_min_nm double, native_max_nm double, native_spacing_nm double, value_scale_applied double, normalized_points double"
ROWS = [("src1", "src1_a", (0.1, 0.2, 0.3), "soil", 402.0), ("src1", "src1_b", (0.3, 0.4, 0.5), "soil", 402.0), ("src2", "src2_a", (0.9, 0.8, 0.7), "soil", 402.0), ("src3", "src3_a", (0.6, 0.6, 0.6), "urban", 2500.0), ("src4", "src4_a", (0.05, 0.06, 0.07), "", 402.0)]


def tables(spark, urban_end=2500.0):
    manifest = spark.createDataFrame([(f"src{k}", f"Source {k}", "prov", "t", "1", "primary") for k in range(1, 7)], "source_id string, name string, provider string, tier string, priority string, ingest_role string")
    metadata = spark.createDataFrame([(s, s.title(), "primary", i, i, "f", "p", 400.0, urban_end if g == "urban" else end, 1.0, 1.0, 2101.0) for s, i, _, g, end in ROWS], META)
    spectra = spark.createDataFrame([(s, i, i, list(v)) for s, i, v, _, _ in ROWS], "source_id string, spectrum_id string, sample_name string, values array<double>")
    labels = spark.createDataFrame([(s, i, i, g, "rule") for s, i, _, g, _ in ROWS], "source_id string, spectrum_id string, sample_name string, landcover_group string, classification_rule string")
    return {"manifest": manifest, "metadata": metadata, "spectra": spectra, "labels": labels}


def test_numbers_of_the_package(spark, tmp_path):
    made = package.package(**tables(spark))
    done = package.write(spark, made, f"file://{tmp_path}/out", 400, 3)
    assert (done["total_spectra"], done["classified_spectra"], done["unlabeled_spectra"], done["source_count"], done["labeled_source_count"], done["landcover_group_count"], done["prototype_rows"]) == (5, 4, 1, 4, 3, 2, 7)
    assert json.loads((tmp_path / "out" / "build_summary.json").read_text())["landcover_counts"] == {"soil": 3, "urban": 1}
    p = {(r.prototype_level, r.landcover_group, r.source_id): r for r in spark.table("landcover_prototypes").collect()}
    assert p["pooled", "soil", None]["values"][0] == pytest.approx(0.4333, abs=1e-4) and p["source_balanced", "soil", None]["values"][0] == pytest.approx(0.55)
    assert p["source", "soil", "src1"]["values"] == pytest.approx([0.2, 0.3, 0.4]) and p["source", "soil", "src2"]["values"][0] == pytest.approx(0.9) and p["pooled", "soil", None].spectra_count == 3
    wide = spark.read.option("header", True).csv(f"file://{tmp_path}/out/tabular/normalized_spectra")
    assert wide.columns[-3:] == ["nm_400", "nm_401", "nm_402"] and package.from_wide(wide).where("spectrum_id = 'src2_a'").first()["values"] == [0.9, 0.8, 0.7]


def test_exclusions_and_short_urban_spectra(spark):
    out = spark.createDataFrame([("src1", "src1_b", None), ("src1", "src1_b", None), ("src2", "gone", "x")], "source_id string, spectrum_id string, reason string")
    made = package.package(**tables(spark, 2400.0), exclude_sources=["src2"], exclude_spectra=out)
    done = package.counts(made)
    assert (done["total_spectra"], done["excluded_source_count"], done["excluded_individual_spectra_count"], done["excluded_spectra_count"]) == (3, 1, 1, 2)
    levels = sorted((r.prototype_level, r.landcover_group) for r in made["landcover_prototypes"].collect())
    assert levels == [("pooled", "soil"), ("source", "soil"), ("source", "urban"), ("source_balanced", "soil")]  # urban: too short for its class
    s = {r.source_id: r for r in made["source_summary"].collect()}
    assert set(s) == {"src1", "src2", "src3", "src4"} and s["src2"].exclusion_reason == "excluded_by_source_id" and s["src2"].spectra_count == 0 and s["src1"].excluded_spectra_count == 1
    assert made["excluded_spectra"].first().exclusion_reason == ""
    with pytest.raises(CodedError):
        package.package(**tables(spark), exclude_spectra=out.withColumn("spectrum_id", F.lit(None).cast("string")))
    with pytest.raises(CodedError):
        package.from_wide(out)


def test_not_in_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    some, none = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([], "k string")
    assert sorted(r.v for r in package.without(rows, some, ["k"]).collect()) == [2] and package.without(rows, none, ["k"]).count() == 3


def test_coverage_rules_and_merging(spark):
    t = tables(spark)
    points = {"src1_a": 1900.0, "src1_b": 1000.0}
    meta = t["metadata"].withColumn("normalized_points", F.coalesce(F.lit(None).cast("double"), *[F.when(F.col("spectrum_id") == k, v) for k, v in points.items()], F.lit(2101.0)))
    summary = spark.createDataFrame([("src1", "1", "p:2"), ("src9", None, "")], "source_id string, failure_count string, parsers string")
    kept, spec, s = curation.by_coverage(meta, t["spectra"], summary, 0.8)
    assert kept.count() == spec.count() == 4 and {r.source_id: (r.normalized_spectra, r.failure_count, r.parsers) for r in s.collect()} == {"src1": (1, 1, "p:1"), "src9": (0, 0, "")}
    with pytest.raises(CodedError):
        curation.by_coverage(meta, t["spectra"], summary, 1.5)
    bssl = meta.withColumn("source_id", F.lit("bssl")).withColumn("native_min_nm", F.when(F.col("spectrum_id") == "src1_a", 600.0).otherwise(400.0)).withColumn("native_spacing_nm", F.lit(5.0))
    r = curation.by_rules(bssl)
    assert r["retained"].count() == 4 and r["excluded"].first().rule_name == "exclude_bssl_longwave_only_subset" and r["by_source"].first().excluded == 1
    one = spark.createDataFrame([(1, "x", "first")], "source_id int, spectrum_id string, v string")
    two = spark.createDataFrame([(1, "x", "second"), (2, "y", "third")], one.schema)
    rows, again = curation.merged([one, two])
    assert sorted(r.v for r in rows.collect()) == ["first", "third"] and [r.v for r in again.collect()] == ["second"]
    with pytest.raises(CodedError):
        curation.merged([one, two.select("v", "source_id", "spectrum_id")])


def test_merging_of_sampled_ranges(spark):
    """Roots dealt by sampled ranges, whose bounds differ from one evaluation to the next: the first row of a key stays."""
    n = 60_000
    root = spark.range(0, n, 1, 1).selectExpr("id div 1000 as source_id", "id % 50 as spectrum_id", "id")
    for _ in range(3):
        one, two = (root.where(c).repartitionByRange(4, "id").sortWithinPartitions("id") for c in ("id % 3 <> 0", "id % 3 <> 1"))
        rows, again = curation.merged([one, two])
        key = lambda i: (i // 1000, i % 50)
        want = {}
        for i in [*(i for i in range(n) if i % 3 != 0), *(i for i in range(n) if i % 3 != 1)]:
            want.setdefault(key(i), i)
        assert sorted(r.id for r in rows.collect()) == sorted(want.values())
        assert again.count() == 2 * (n - n // 3) - len(want)


def test_source_rules(spark):
    names = [("existing_urban_reference_data", "a", "urban", 400.0, 1.0), ("ossl", "b", "soil", 452.0, 1.0), ("ossl", "c", "soil", 400.0, 1.0), ("ghisaconus_v001", "d", "vegetation", 400.0, 1.0), ("ghisaconus_v001", "e", "vegetation", 400.0, 1.0), ("santa_barbara_urban_reflectance", "f", "urban", 400.0, 1.0)]
    meta = spark.createDataFrame([(s, i, low, scale) for s, i, _, low, scale in names], "source_id string, spectrum_id string, native_min_nm double, value_scale_applied double")
    labels = spark.createDataFrame([(s, i, g) for s, i, g, _, _ in names], "source_id string, spectrum_id string, landcover_group string")
    spectra = spark.createDataFrame([(s, i, i, [1.0] * 110) for s, i, *_ in names], "source_id string, spectrum_id string, sample_name string, values array<double>")
    donors = spark.createDataFrame([("ghisaconus_v001", "d", "d", [2.0] * 110), ("ghisaconus_v001", "e", "e", [None] + [2.0] * 109)], spectra.schema)
    kept, rows = curation.by_source_rules(meta, labels, spectra, donors)
    got = {r.spectrum_id: r["values"] for r in rows.collect()}
    assert set(got) == {"c", "d", "e", "f"} and got["d"] == [2.0] * 100 + [1.0] * 10 and got["e"] == [1.0] * 110 and got["f"][0] == pytest.approx(1e-4)
    assert {r.spectrum_id: r.value_scale_applied for r in kept.collect()}["f"] == 10000


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    a, b = (sorted(map(tuple, curation.sampled(rows.repartition(n), ["g"], 7, ["k"], 5).collect())) for n in (2, 9))
    assert a == b and len(a) == 21
    assert reports.group_samples(rows, [0, 2], 4, 1, ["k"], "g").groupBy("g").count().collect()[0][1] == 4


def test_source_catalogue(spark, tmp_path):
    for name, artifacts in (("a", [{"artifact_id": "x", "size_bytes": 3}, {"artifact_id": "y"}]), ("b", [])):
        (tmp_path / "results" / name).mkdir(parents=True)
        (tmp_path / "results" / name / "fetch-result.json").write_text(json.dumps({"source_id": name, "source_name": name, "fetch_adapter": "z", "fetch_mode": "assets", "status": "downloaded", "notes": ["n1", "n2"], "artifacts": artifacts}, indent=1))
    manifest = spark.createDataFrame([(n, n, "t1", "active", "z") for n in "abc"], "source_id string, name string, tier string, status string, fetch_adapter string")
    done = source_catalogue.assemble(spark, manifest, f"file://{tmp_path}/results", f"file://{tmp_path}/out")
    assert done == {"manifest_sources": 3, "fetched_sources": 2, "artifact_rows": 2, "manifest_status_counts": {"active": 3}, "fetch_status_counts": {"downloaded": 2}}
    view = {r.source_id: (r.fetch_status, r.fetch_mode, r.artifact_count) for r in spark.table("source_build_status").collect()}
    assert view == {"a": ("downloaded", "assets", 2), "b": ("downloaded", "assets", 0), "c": ("not_fetched", "", 0)}
    assert spark.table("fetch_results").where("source_id = 'a'").first().notes == "n1 | n2"


def test_land_cover_maps(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": null}',), ("[1]",), ("x",), (None,)], "j string")
    assert [r[0] for r in rows.select(landcover.metadata_map(F.col("j"))).collect()] == [{"a": "1", "b": ""}, {}, {}, {}]


def test_quality_tables(spark):
    t = tables(spark)
    summary = spark.createDataFrame([("src1", 2, 2), ("src2", 1, 0)], "source_id string, normalized_spectra long, failure_count long")
    q = reports.quality_tables(t["metadata"], summary)
    assert q["largest_sources"].first().source_id == "src1" and q["failure_rates"].first().failure_rate == 0.5 and q["metrics"].first().sources == 4 and q["metrics"].first().p05_coverage == 1
    empty = reports.stage_report(t["metadata"], {"none": t["metadata"].limit(0)})
    assert empty["by_source"].count() == 0 and empty["overall"].count() == 0


def test_rebuild(spark, tmp_path):
    """All stages over a small library: a spike of one source goes, rows of short coverage go, the others stay."""
    rng, x = np.random.default_rng(3), np.arange(2101)
    base = 0.3 + 0.1 * np.sin(x / 300)
    spiky = base.copy()
    spiky[1500] += 0.4  # 1900 nm
    rows = [("emit_x", "e1", spiky, 2101.0), ("emit_x", "e2", base, 2101.0), ("bssl", "b1", base + 0.001 * rng.normal(size=2101), 2101.0), ("bssl", "b2", base, 900.0), ("ghisacasia_v001", "g1", base, 2101.0)]
    metadata = spark.createDataFrame([(s, s, "primary", i, i, "f", "p", 350.0, 2500.0, 1.0, 1.0, n) for s, i, _, n in rows], META).withColumn("metadata_json", F.lit("{}"))
    spectra = spark.createDataFrame([(s, i, i, v.tolist()) for s, i, v, _ in rows], "source_id string, spectrum_id string, sample_name string, values array<double>")
    labels = spark.createDataFrame([(s, i, i, "soil", "rule") for s, i, _, _ in rows], "source_id string, spectrum_id string, sample_name string, landcover_group string, classification_rule string")
    summary = spark.createDataFrame([(s, 2, 0) for s in ("emit_x", "bssl", "ghisacasia_v001")], "source_id string, normalized_spectra int, failure_count int")
    manifest = spark.createDataFrame([(s, s, "prov", "t", "1", "primary") for s in ("emit_x", "bssl", "ghisacasia_v001")], "source_id string, name string, provider string, tier string, priority string, ingest_role string")
    made = rebuild.rebuild(spark, {"metadata": metadata, "spectra": spectra, "summary": summary, "labels": labels}, manifest, f"file://{tmp_path}/work")
    assert package.counts(made)["total_spectra"] == 4
    done = rebuild.affected(spark, f"file://{tmp_path}/work")
    first = done["03_artifacts"].collect()
    assert [(r.spectrum_id, r.repair) for r in first] == [("e1", "emit_second_absorption_interp")]
    after = spark.read.parquet(f"file://{tmp_path}/work/03_artifacts/spectra")
    assert after.where("spectrum_id = 'e1'").first()["values"][1500] == pytest.approx(base[1500], abs=1e-3)
