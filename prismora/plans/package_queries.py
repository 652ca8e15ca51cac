"""Queries of the package, the source catalogue and curation on tables made from the stand-ins, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curation, curves, landcover
from ..operators.quantiles import quantiles
from . import reports, source_catalogue
from .catalogue import query, r6, table
from .package import package, without

# The tables, on both sides: spectra are the vectors, sources their number modulo 9, some labelled, some excluded.
_SQL = """with metadata as (select 'src' || (vec_id % 9) as source_id, 'Source ' || (vec_id % 9) as source_name, 's' || vec_id as spectrum_id, 'n' || (vec_id // 2) as sample_name, 'p' || (vec_id % 3) as parser,
  (2400 + (vec_id * 37) % 120)::double as native_max_nm, (380 + vec_id % 60)::double as native_min_nm, (1500 + (vec_id * 13) % 602)::double as normalized_points, vec_id from embeddings where vec_id % 9 <> 8),
labels as (select source_id, spectrum_id, sample_name, nullif(case vec_id % 5 when 0 then 'urban' when 1 then 'soil' when 2 then 'soil' when 3 then 'water' else '' end, '') as landcover_group, 'r' || (vec_id % 5) as classification_rule from metadata where vec_id % 11 <> 0),
manifest as (select 'src' || n_nationkey as source_id, n_name as name, 'prov' || n_regionkey as provider, 't' || (n_nationkey % 3) as tier, n_nationkey::varchar as priority, 'role' || (n_nationkey % 2) as ingest_role, 'subsec' as subsection from nation where n_nationkey < 12),
out_sources as (select unnest(['src2', 'src8']) as source_id),
out_spectra as (select distinct source_id, spectrum_id, 'bad ' || (vec_id % 2) as reason from metadata where vec_id % 97 = 5),
meta as (select m.*, l.landcover_group, l.classification_rule, normalized_points / 2101.0 as coverage_fraction from metadata m left join labels l using (source_id, spectrum_id, sample_name)
  where m.source_id not in (select source_id from out_sources) and (m.source_id, m.spectrum_id) not in (select source_id, spectrum_id from out_spectra)),
available as (select source_id, count(*) as n, avg(normalized_points / 2101.0) as cover, min(native_min_nm) as low, max(native_max_nm) as high from metadata group by all),
msources as (select ms.*, coalesce(a.n, 0) as available_spectra_count, a.cover, a.low, a.high, ex.source_id is null as included, case when ex.source_id is not null then 'excluded_by_source_id' end as exclusion_reason
  from manifest ms left join available a using (source_id) left join out_sources ex using (source_id) where source_id in (select source_id from metadata union select source_id from out_sources))"""


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    every = e.where(v % 9 != 8)
    metadata = every.select(
        name("src", v % 9).alias("source_id"), name("Source ", v % 9).alias("source_name"), name("s", v).alias("spectrum_id"), name("n", F.floor(v / 2)).alias("sample_name"), name("p", v % 3).alias("parser"), F.lit("role").alias("ingest_role"), F.lit("file").alias("input_path"),
        (2400 + (v * 37) % 120).cast("double").alias("native_max_nm"), (380 + v % 60).cast("double").alias("native_min_nm"), F.lit(1.0).alias("value_scale_applied"), (1500 + (v * 13) % 602).cast("double").alias("normalized_points"), "vec_id",
    )
    group = F.when(v % 5 == 0, "urban").when(v % 5 <= 2, "soil").when(v % 5 == 3, "water").otherwise("")
    labels = metadata.where(v % 11 != 0).select("source_id", "spectrum_id", "sample_name", group.alias("landcover_group"), name("r", v % 5).alias("classification_rule"))
    n = F.col("n_nationkey")
    manifest = table(spark, sf_dir, "nation").where(n < 12).select(name("src", n).alias("source_id"), F.col("n_name").alias("name"), name("prov", F.col("n_regionkey")).alias("provider"), name("t", n % 3).alias("tier"), n.cast("string").alias("priority"), name("role", n % 2).alias("ingest_role"), F.lit("subsec").alias("subsection"))
    spectra = metadata.select("source_id", "spectrum_id", "sample_name", "vec_id").join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("values")), "vec_id").drop("vec_id")
    out = metadata.where(v % 97 == 5).select("source_id", "spectrum_id", name("bad ", v % 2).alias("reason"))
    return {"manifest": manifest, "metadata": metadata, "spectra": spectra, "labels": labels, "exclude_spectra": out}


def built(spark, sf_dir) -> dict[str, DataFrame]:
    return package(**tables(spark, sf_dir), exclude_sources=["src2", " src8 ", ""])


@query(_SQL + " select source_id, spectrum_id, sample_name, landcover_group, classification_rule, round(coverage_fraction, 6) as coverage_fraction from meta")
def package_metadata(spark, sf_dir):
    """Metadata with labels on three keys, without excluded sources and spectra."""
    m = built(spark, sf_dir)["spectra_metadata"]
    return m.select("source_id", "spectrum_id", "sample_name", "landcover_group", "classification_rule", r6("coverage_fraction").alias("coverage_fraction"))


@query(_SQL + ", e as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings) select source_id, spectrum_id, landcover_group, pos::bigint as pos, round(v, 6) as value from meta join e using (vec_id) where pos % 16 = 0 and vec_id % 7 = 0")
def package_spectra(spark, sf_dir):
    """Metadata joined with spectra on three keys; a few places of some, to keep the result small."""
    rows = built(spark, sf_dir)["spectra"].where("vec_id % 7 = 0").select("source_id", "spectrum_id", "landcover_group", F.posexplode("values").alias("pos", "value"))
    return rows.where("pos % 16 = 0").select("source_id", "spectrum_id", "landcover_group", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query(_SQL + " select source_id, name, available_spectra_count::bigint as available_spectra_count, round(cover, 6) as cover, included, exclusion_reason from msources")
def package_manifest(spark, sf_dir):
    m = built(spark, sf_dir)["manifest_sources"]
    return m.select("source_id", "name", "available_spectra_count", r6("available_mean_coverage_fraction").alias("cover"), F.col("included_in_spectra").alias("included"), "exclusion_reason")


@query(_SQL + """ select ms.source_id, coalesce(max(m.source_name), max(ms.name)) as source_name, max(ms.provider) as provider, bool_or(ms.included) as included, max(ms.available_spectra_count)::bigint as available, count(m.spectrum_id)::bigint as spectra,
greatest(max(ms.available_spectra_count) - count(m.spectrum_id), 0)::bigint as excluded, (count(m.spectrum_id) filter (where m.landcover_group is not null))::bigint as labeled, (count(m.spectrum_id) filter (where m.landcover_group is null))::bigint as unlabeled,
count(distinct m.landcover_group)::bigint as groups, round(case when count(m.spectrum_id) > 0 then avg(m.coverage_fraction) else max(ms.cover) end, 6) as cover, coalesce(min(m.native_min_nm), max(ms.low)) as low, coalesce(max(m.native_max_nm), max(ms.high)) as high, max(ms.exclusion_reason) as reason
from msources ms left join meta m using (source_id) group by ms.source_id""")
def package_source_summary(spark, sf_dir):
    s = built(spark, sf_dir)["source_summary"]
    return s.select(
        "source_id", "source_name", "provider", F.col("included_in_spectra").alias("included"), F.col("available_spectra_count").alias("available"), F.col("spectra_count").alias("spectra"), F.col("excluded_spectra_count").alias("excluded"), F.col("labeled_spectra_count").alias("labeled"),
        F.col("unlabeled_spectra_count").alias("unlabeled"), F.col("landcover_group_count").alias("groups"), r6("mean_coverage_fraction").alias("cover"), F.col("min_native_nm").alias("low"), F.col("max_native_nm").alias("high"), F.col("exclusion_reason").alias("reason"),
    )


@query(_SQL + " select ex.source_id, ex.spectrum_id, m.source_name, m.sample_name, l.landcover_group, ex.reason from out_spectra ex left join metadata m using (source_id, spectrum_id) left join labels l using (source_id, spectrum_id) where ex.source_id not in (select source_id from out_sources)")
def package_excluded_spectra(spark, sf_dir):
    return built(spark, sf_dir)["excluded_spectra"].select("source_id", "spectrum_id", "source_name", "sample_name", "landcover_group", F.col("exclusion_reason").alias("reason"))


@query(_SQL + " select landcover_group, count(*)::bigint as spectra, count(distinct source_id)::bigint as sources, round(avg(coverage_fraction), 6) as cover from meta where landcover_group is not null group by all")
def package_landcover_summary(spark, sf_dir):
    return built(spark, sf_dir)["landcover_summary"].select("landcover_group", F.col("spectra_count").alias("spectra"), F.col("source_count").alias("sources"), r6("mean_coverage_fraction").alias("cover"))


@query(_SQL + " select source_id, spectrum_id, landcover_group, native_max_nm from meta where landcover_group is not null and (landcover_group <> 'urban' or native_max_nm >= 2450)")
def package_eligible(spark, sf_dir):
    return built(spark, sf_dir)["prototype_eligible_metadata"].select("source_id", "spectrum_id", "landcover_group", "native_max_nm")


@query(_SQL + """, x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings),
l as (select landcover_group as g, source_id, vec_id, native_max_nm, pos, v from meta join x using (vec_id) where landcover_group is not null), e as (select * from l where g <> 'urban' or native_max_nm >= 2450),
s as (select g, source_id, pos, avg(v) as m, count(*) as n from l group by all), es as (select g, source_id, pos, avg(v) as m, count(*) as n from e group by all)
select 'source' as level, g, source_id, pos::bigint as pos, round(m, 6) as value, n::bigint as spectra, 1::bigint as sources from s union all
select 'pooled', g, null, pos, round(avg(v), 6), count(*), count(distinct source_id) from e group by g, pos union all select 'source_balanced', g, null, pos, round(avg(m), 6), sum(n)::bigint, count(*) from es group by g, pos""")
def package_prototypes(spark, sf_dir):
    """Prototypes of three levels, from partial sums of whole arrays."""
    p = built(spark, sf_dir)["landcover_prototypes"]
    rows = p.select(F.col("prototype_level").alias("level"), F.col("landcover_group").alias("g"), "source_id", F.col("spectra_count").alias("spectra"), F.col("source_count").alias("sources"), F.posexplode("values").alias("pos", "value"))
    return rows.select("level", "g", "source_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"), "spectra", "sources")


@query("select count(*)::bigint as n from orders where (o_orderstatus, o_orderpriority) not in (select * from (values ('O', '1-URGENT'), ('F', '5-LOW')))")
def anti_two_columns(spark, sf_dir):
    """Two columns NOT IN a table of pairs, as a hash anti join."""
    out = spark.createDataFrame([("O", "1-URGENT"), ("F", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    return without(table(spark, sf_dir, "orders"), out, ["o_orderstatus", "o_orderpriority"]).agg(F.count("*").alias("n"))


@query("""with s as (select c_custkey::varchar as source_id, c_mktsegment as tier from customer), f as (select o_custkey::varchar as source_id, o_orderstatus as status, o_orderpriority as fetch_mode from orders where o_orderkey % 7 = 0),
a as (select o_custkey::varchar as source_id, nullif(l_linestatus, 'F') as artifact_id from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 7 = 0)
select source_id, tier, coalesce(f.status, 'not_fetched') as fetch_status, coalesce(fetch_mode, '') as fetch_mode, count(artifact_id)::bigint as artifact_count from s left join f using (source_id) left join a using (source_id) group by all""")
def source_build_status(spark, sf_dir):
    """Sources with their fetch results and the number of artifacts, which are counted before the joins."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0")
    key = lambda c: F.col(c).cast("string").alias("source_id")
    none = F.lit(None).cast("string")
    s = table(spark, sf_dir, "customer").select(key("c_custkey"), none.alias("name"), F.col("c_mktsegment").alias("tier"), none.alias("status"), none.alias("fetch_adapter"))
    f = orders.select(key("o_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("fetch_mode"))
    a = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(key("o_custkey"), F.nullif("l_linestatus", F.lit("F")).alias("artifact_id"))
    return source_catalogue.status_view(s, f, a).select("source_id", "tier", "fetch_status", "fetch_mode", "artifact_count")


@query("select o_orderstatus as status, count(*)::bigint as n from orders group by all")
def status_histogram(spark, sf_dir):
    return curation.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("select n_nationkey::bigint as n_nationkey, n_name from nation where n_name in ('FRANCE', 'CHINA', 'PERU', 'BRAZIL') or n_nationkey in (3, 4) order by n_name limit 3")
def manifest_selection(spark, sf_dir):
    """Sources by several attributes, the first three by name."""
    n = table(spark, sf_dir, "nation")
    a = curation.selected(n, n_name=["FRANCE", "CHINA", "PERU", "BRAZIL"], n_regionkey=[])
    b = curation.selected(n, n_nationkey=[3, 4])
    return curation.selected(a.unionByName(b).distinct(), 3, "n_name").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query(_SQL + """, kept as (select * from metadata where normalized_points / 2101.0 >= 0.8), p as (select source_id, string_agg(parser || ':' || n, ',' order by parser) as parsers, sum(n) as n from (select source_id, parser, count(*) as n from kept group by all) group by all)
select source_id, (vec % 4)::bigint as failure_count, coalesce(n, 0)::bigint as normalized_spectra, coalesce(parsers, '') as parsers from (select 'src' || x as source_id, x as vec from range(10) t(x)) left join p using (source_id)""")
def coverage_summary(spark, sf_dir):
    """The source summary rebuilt after the coverage filter; failures stay, sources without spectra too."""
    t = tables(spark, sf_dir)
    summary = spark.range(10).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source_id"), (F.col("id") % 4).alias("failure_count"), F.lit("x").alias("parsers"))
    return curation.by_coverage(t["metadata"], t["spectra"], summary)[2].select("source_id", "failure_count", "normalized_spectra", "parsers")


@query(_SQL + " select source_id, count(*)::bigint as total, (count(*) filter (where native_min_nm <= 410 and native_max_nm >= 2450))::bigint as kept, round(avg((native_min_nm <= 410 and native_max_nm >= 2450)::int), 6) as kept_fraction from metadata group by all")
def native_range_report(spark, sf_dir):
    return curation.by_native_range(tables(spark, sf_dir)["metadata"], 410, 2450)[1].select("source_id", "total", "kept", r6("kept_fraction").alias("kept_fraction"))


RULES = [{"name": "late", "source_id": "src1", "native_min_nm_min": 400.0, "normalized_points_min": 1700.0, "reason": "starts late"}, {"name": "all", "source_id": "src3", "reason": "gone"}, {"name": "few", "source_id": "src1", "normalized_points_min": 2000.0, "reason": "many"}]


@query(_SQL + """, hits as (select 'late' as rule_name, * from metadata where source_id = 'src1' and native_min_nm >= 400 and normalized_points >= 1700 union all select 'all', * from metadata where source_id = 'src3' union all select 'few', * from metadata where source_id = 'src1' and normalized_points >= 2000)
select rule_name, source_id, count(distinct spectrum_id)::bigint as excluded_spectra from hits group by all""")
def subset_rule_summary(spark, sf_dir):
    """Rules as data: spectra that each excludes."""
    return curation.by_rules(tables(spark, sf_dir)["metadata"], RULES)["by_rule"]


@query(_SQL + """, hit as (select *, (source_id = 'src1' and native_min_nm >= 400 and normalized_points >= 1700) or source_id = 'src3' or (source_id = 'src1' and normalized_points >= 2000) as h from metadata)
select source_id, count(*)::bigint as total, (count(*) filter (where h))::bigint as excluded, (count(*) filter (where not h))::bigint as retained, round(avg(h::int), 6) as excluded_fraction from hit group by all""")
def subset_rule_sources(spark, sf_dir):
    return curation.by_rules(tables(spark, sf_dir)["metadata"], RULES)["by_source"].withColumn("excluded_fraction", r6("excluded_fraction"))


@query("""with m as (select 'src' || (vec_id % 9) as source_id, vec_id from embeddings) select source_id, count(*)::bigint as n from m where source_id not in ('src1', 'src4') group by all""")
def source_exclusion(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src"), (F.col("vec_id") % 9).cast("string")).alias("source_id"), "vec_id")
    kept = curation.without_sources({"m": m, "grid": spark.range(3)}, ["src1", "src4 "])
    return kept["m"].groupBy("source_id").agg(F.count("*").alias("n"))


@query("select n_nationkey::bigint as n_nationkey, case when n_name in ('FRANCE', 'CHINA') then case when n_nationkey % 2 = 0 then 'kept note ' else '' end || 'left out' when n_nationkey % 2 = 0 then 'kept note' else '' end as notes from nation")
def manifest_notes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), F.col("n_nationkey").cast("long").alias("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, "kept note").alias("notes"))
    return curation.annotated(n, ["FRANCE", "CHINA"], "left out").select("n_nationkey", "notes")


_ROOTS = "with r as (select 0 as root, o_custkey as source_id, o_orderstatus as spectrum_id, o_orderkey, row_number() over (order by o_orderkey) as p from orders where o_orderkey % 3 <> 0 union all select 1, o_custkey, o_orderstatus, o_orderkey, row_number() over (order by o_orderkey) from orders where o_orderkey % 3 <> 1)"


@query(_ROOTS + ", d as (select *, row_number() over (partition by source_id, spectrum_id order by root, p) as nth from r) select source_id, spectrum_id, o_orderkey from d where nth = 1")
def merged_roots(spark, sf_dir):
    """Two roots one after another; of rows with one key the first root's first stays."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("spectrum_id"), "o_orderkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    return curation.merged([o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1")])[0]


@query(_SQL + """, f as (select 'src' || (n_nationkey % 4) as source_id from nation), p as (select source_id, string_agg(parser || ':' || n, ',' order by parser) as parsers, sum(n) as n from (select source_id, parser, count(*) as n from metadata group by all) group by all)
select m.source_id, any_value(source_name) as source_name, coalesce(any_value(k.n), 0)::bigint as failure_count, any_value(p.n)::bigint as normalized_spectra, any_value(p.parsers) as parsers from metadata m left join (select source_id, count(*) as n from f group by all) k using (source_id) left join p using (source_id) group by m.source_id""")
def merged_source_summary(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") % 4).cast("string")).alias("source_id"))
    return curation.merged_summary(tables(spark, sf_dir)["metadata"], f).drop("ingest_role")


@query("with e as (select user_id, event_id, lag(user_id) over (order by event_id) as before from events) select user_id, (count(*) filter (where before is null or before <> user_id))::bigint as runs from e group by all")
def grouped_order(spark, sf_dir):
    """In how many runs do a user's events stand? One run is in order."""
    return curation.contiguous(table(spark, sf_dir, "events"), "user_id", "event_id")


@query(_SQL + """, x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings), l as (select landcover_group as g, source_id, pos, v from meta join x using (vec_id) where landcover_group is not null),
s as (select g, source_id, pos, avg(v) as m, count(*) as n, sum(v) as t from l group by all), p as (select g, pos, sum(t) / sum(n) as m, sum(n) as n from s group by all), j as (select *, lead(m) over w - m as jump, lead(n) over w as rn from p window w as (partition by g order by pos)),
top as (select *, row_number() over (partition by g order by abs(jump) desc, pos) as rank from j where jump is not null qualify rank <= 5),
c as (select t.g, t.rank, t.pos, a.source_id, a.n / t.n as wl, b.n / t.rn as wr, a.m as ml, b.m as mr from top t join s a on a.g = t.g and a.pos = t.pos join s b on b.g = t.g and b.pos = t.pos + 1 and b.source_id = a.source_id),
k as (select *, wr * mr - wl * ml as net, row_number() over (partition by g, rank order by abs(wr * mr - wl * ml) desc, source_id) as nth from c)
select g, rank as jump_rank, pos::bigint as left_pos, source_id, nth as contributor_rank, round(net, 6) + 0 as net, round((wr - wl) * mr, 6) + 0 as composition, round(wl * (mr - ml), 6) + 0 as within from k where nth <= 8""")
def jump_contributions(spark, sf_dir):
    """The largest steps of pooled means, and what each source adds: net, by composition, within."""
    s = built(spark, sf_dir)["labeled_spectra"].select(F.col("landcover_group").alias("g"), "source_id", "values")
    points = curves.long(curves.sums(s, ["g", "source_id"]), "g", "source_id")
    found = curves.jumps(curves.pooled(points, "g"), "g", 5)
    c = curves.contributions(points, found, "g", "source_id", 8)
    return c.select("g", "jump_rank", "left_pos", "source_id", "contributor_rank", *[(r6(x) + 0.0).alias(x) for x in ("net", "composition", "within")])  # -0.0 as 0.0


# reports


def _staged(spark, sf_dir) -> dict[str, DataFrame]:
    m = tables(spark, sf_dir)["metadata"]
    return {"one": m.where("vec_id % 3 = 0").unionByName(m.where("vec_id % 6 = 0")), "two": m.where("vec_id % 5 = 0 and source_id <> 'src1'")}


@query(_SQL + """, total as (select source_id, count(distinct spectrum_id) as total from metadata group by all), st as (select 'one' as stage, source_id, spectrum_id from metadata where vec_id % 3 = 0 union all select 'two', source_id, spectrum_id from metadata where vec_id % 5 = 0 and source_id <> 'src1')
select stage, source_id, count(distinct spectrum_id)::bigint as affected_spectra, max(total)::bigint as total_spectra, round(count(distinct spectrum_id) / max(total), 6) as affected_pct from st left join total using (source_id) group by all""")
def repair_stage_report(spark, sf_dir):
    r = reports.stage_report(tables(spark, sf_dir)["metadata"], _staged(spark, sf_dir))["by_source"]
    return r.select("stage", "source_id", "affected_spectra", "total_spectra", r6("affected_pct").alias("affected_pct"))


@query(_SQL + """, total as (select source_id, count(distinct spectrum_id) as total from metadata group by all), st as (select source_id, spectrum_id from metadata where vec_id % 3 = 0 or (vec_id % 5 = 0 and source_id <> 'src1'))
select source_id, count(distinct spectrum_id)::bigint as affected_spectra, max(total)::bigint as total_spectra from st join total using (source_id) group by all""")
def repair_overall(spark, sf_dir):
    return reports.stage_report(tables(spark, sf_dir)["metadata"], _staged(spark, sf_dir))["overall"].drop("affected_pct")


def _labeled(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("src"), (F.col("vec_id") % 9).cast("string")).alias("source_id"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("landcover_group"), F.col("embedding").cast("array<double>").alias("values"))


@query("""with l as (select 'g' || label as g, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings), a as (select g, pos, avg(v) as m from l group by all), b as (select g, pos, avg(case when pos % 8 = 0 then v / 2 else v end) as m from l group by all)
select g as landcover_group, pos::bigint as pos, round(a.m, 6) as before, round(b.m, 6) as after, round(b.m - a.m, 6) as delta from a join b using (g, pos)""")
def before_after_means(spark, sf_dir):
    before = _labeled(spark, sf_dir)
    after = before.withColumn("values", F.transform("values", lambda v, i: F.when(i % 8 == 0, v / 2).otherwise(v)))
    r = reports.before_after(before, after)
    return r.select("landcover_group", "pos", *[r6(c).alias(c) for c in ("before", "after", "delta")])


@query("select 'g' || label as landcover_group, count(*)::bigint as n, round(avg(abs(embedding[22]::double - embedding[21]::double)), 6) as mean_abs_jump, round(avg(abs(embedding[20]::double - 2 * embedding[21]::double + embedding[22]::double)), 6) as mean_abs_curvature from embeddings group by all")
def boundary_report(spark, sf_dir):
    r = reports.boundary_means(_labeled(spark, sf_dir), 20)
    return r.select("landcover_group", "n", r6("mean_abs_jump").alias("mean_abs_jump"), r6("mean_abs_curvature").alias("mean_abs_curvature"))


@query("""with l as (select 'src' || (vec_id % 9) as source_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings where vec_id % 9 in (1, 4)), m as (select source_id, pos, avg(v) as m from l group by all)
select source_id, w as window, round(avg(abs(m * 0.1)), 6) as mean_abs_delta, round(max(abs(m * 0.1)), 6) as max_abs_delta from m join (values ('src1', 'low', 4, 12), ('src1', 'high', 40, 50), ('src4', 'low', 0, 3)) t(s, w, lo, hi) on s = source_id and pos between lo and hi group by all""")
def window_delta_report(spark, sf_dir):
    before = _labeled(spark, sf_dir)
    after = before.withColumn("values", F.transform("values", lambda v: v * 1.1))
    r = reports.window_deltas(before, after, {"src1": [("low", 404, 412), ("high", 440, 450)], "src4": [("low", 400, 403)]})
    return r.select("source_id", "window", r6("mean_abs_delta").alias("mean_abs_delta"), r6("max_abs_delta").alias("max_abs_delta"))


# land cover

_SOURCES = ["hyspiri_ground_targets", "drylands_emit", "antarctic_vegetation_speclib", "ossl", "ghisacasia_v001", "usgs_v7", "ecostress_v1", "emit_l2a_surface", "somewhere", "elsewhere"]
_PATHS = ["a/ASCIIdata_splib07b_cvASD/ChapterV_Vegetation/x.txt", "manmade.roof.txt", "d/filtered_ocean.csv", "rock/granite.txt", "lake/oak tree.csv", "asphalt.txt", "b/filtered_veg.hdr", "soil.clay.txt", "ChapterL_Liquids/x.txt"]
_JSON = ['{"level_1": "Soil"}', '{"level_1": "pv"}', '{"level_1": "npv"}', "[1]", "not json", "{}"]
_NAMES = ["Dry lake", "basalt top", "grass +const", "plain", "Water body", "tile"]


def _pick(values: list[str], expression: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({expression}) % {len(values)} + 1]"


@query(f"""with m as (select vec_id, {_pick(_SOURCES, 'vec_id')} as source_id, {_pick(_PATHS, 'vec_id // 10')} as input_path, {_pick(_NAMES, 'vec_id // 3')} as sample_name, {_pick(_JSON, 'vec_id // 7')} as metadata_json from embeddings),
n as (select *, case source_id when 'somewhere' then 'urban atlas' when 'elsewhere' then 'set' else 'x' end as nm, case source_id when 'elsewhere' then (case when vec_id % 2 = 0 then '' else '' end) else '' end as sub, '' as typ from m),
t as (select *, nm || ' ' || typ || ' ' || lower(sample_name) || ' ' || lower(input_path) as whole, lower(coalesce(case when json_valid(metadata_json) and json_type(metadata_json) = 'OBJECT' then json_extract_string(metadata_json, '$.level_1') end, '')) as lev,
  split_part(regexp_replace(input_path, '^.*ASCIIdata_splib07b_cvASD/', ''), '/', 1) as chapter, split_part(regexp_extract(input_path, '[^/]*$'), '.', 1) as prefix, regexp_replace(regexp_extract(input_path, '[^/]*$'), '\\.[^.]*$', '') as stem from n),
k as (select *, list_filter([{', '.join(f"case when regexp_matches(whole, '{'|'.join(w.split())}') then '{g}' end" for g, w in landcover.WORDS.items())}], lambda v: v is not null) as hits from t),
v as (select vec_id, case when source_id = 'hyspiri_ground_targets' then ['soil', 'hyspiri:playa_dry_lake'] when source_id = 'drylands_emit' and lev = 'soil' then ['soil', 'drylands_emit:metadata_level_1=soil'] when source_id = 'drylands_emit' and lev = 'pv' then ['vegetation', 'drylands_emit:metadata_level_1=pv']
  when source_id = 'drylands_emit' and lev = 'npv' then [null, 'drylands_emit:metadata_level_1=npv'] when source_id = 'antarctic_vegetation_speclib' and regexp_matches(lower(sample_name || ' ' || input_path), '{'|'.join(landcover.ROCKS.split())}') then ['soil', 'antarctic:rock_associated']
  when source_id = 'ossl' then ['soil', 'source:ossl'] when source_id = 'ghisacasia_v001' then ['vegetation', 'source:ghisacasia_v001'] when source_id = 'usgs_v7' and (contains(lower(sample_name), '+const')) then [null, 'usgs:perturbed_variant']
  when source_id = 'usgs_v7' and chapter = 'ChapterV_Vegetation' then ['vegetation', 'usgs:ChapterV_Vegetation'] when source_id = 'usgs_v7' and chapter = 'ChapterL_Liquids' then ['water', 'usgs:ChapterL_Liquids']
  when source_id = 'ecostress_v1' and prefix = 'manmade' then ['urban', 'ecostress:manmade'] when source_id = 'ecostress_v1' and prefix = 'soil' then ['soil', 'ecostress:soil']
  when source_id = 'emit_l2a_surface' and stem = 'filtered_veg' then ['vegetation', 'emit:filtered_veg'] when source_id = 'emit_l2a_surface' and stem = 'filtered_ocean' then ['water', 'emit:filtered_ocean']
  when contains(nm, 'urban') then ['urban', 'subsection_or_name:' || nm] when len(hits) = 1 then [hits[1], 'keyword'] else [null, 'unclassified'] end as r from k)
select vec_id, r[1] as landcover_group, r[2] as classification_rule from v""")
def landcover_classify(spark, sf_dir):
    """The cascade of rules on made-up metadata: special sources, pure sources, chapters, prefixes, stems, names, words."""
    v = F.col("vec_id")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    metadata = table(spark, sf_dir, "embeddings").select("vec_id", pick(_SOURCES, v).alias("source_id"), pick(_PATHS, F.floor(v / 10)).alias("input_path"), pick(_NAMES, F.floor(v / 3)).alias("sample_name"), pick(_JSON, F.floor(v / 7)).alias("metadata_json"))
    names = {"somewhere": "Urban Atlas", "elsewhere": "Set"}
    manifest = spark.createDataFrame([(s, names.get(s, "x"), "", "") for s in _SOURCES], "source_id string, name string, subsection string, spectral_type string")
    return landcover.classified(metadata, manifest).select("vec_id", "landcover_group", "classification_rule")


@query("""with a as (select 'g' || label as landcover_group, 'src' || (vec_id % 9) as source_id, vec_id % 4 as cluster_id, embedding[1]::double as outlier_score, embedding[1] > 0.1 as is_outlier from embeddings)
select landcover_group, count(*)::bigint as classified_spectra, count(distinct source_id)::bigint as source_count, count(distinct cluster_id)::bigint as cluster_count, (count(*) filter (where is_outlier))::bigint as flagged_outliers, round(avg(is_outlier::int), 6) as outlier_rate from a group by all""")
def landcover_group_summary(spark, sf_dir):
    x = F.col("embedding")[0]
    a = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("landcover_group"), F.concat(F.lit("src"), (F.col("vec_id") % 9).cast("string")).alias("source_id"), (F.col("vec_id") % 4).alias("cluster_id"), x.alias("outlier_score"), (x > F.lit(0.1).cast("float")).alias("is_outlier"))
    return landcover.group_summary(a).withColumn("outlier_rate", r6("outlier_rate"))


@query("""select o_orderpriority, count(*)::bigint as n, round(quantile_cont(o_totalprice, 0.0), 6) as q0, round(quantile_cont(o_totalprice, 0.01), 6) as q1, round(median(o_totalprice), 6) as q50, round(quantile_cont(o_totalprice, 0.999), 6) as q999 from orders group by all""")
def exact_quantiles(spark, sf_dir):
    """Exact quantiles by an approximate bracket."""
    q = quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.0, 0.01, 0.5, 0.999])
    return q.select("o_orderpriority", "n", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(["q0", "q1", "q50", "q999"])])

