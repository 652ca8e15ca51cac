"""Queries of statistics, repairs and cell functions, and their SQL; registered in the catalogue."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sql_functions
from ..functions import repairs as R
from ..functions import series as S
from ..functions.whittaker import smooth
from ..operators import repairs, review, series, statistics
from ..operators.quantiles import quantiles
from .catalogue import _LONG, _long, query, r6, table


@query(_LONG + """, m as (select pos, median(v) as center, stddev_pop(v) as sd from l group by all),
d as (select pos, center, sd, 1.4826 * median(abs(v - center)) as mad from l join m using (pos) group by all)
select pos::bigint as pos, round(center, 6) as center, round(case when mad > 1e-6 then mad when sd > 1e-6 then sd else 1 end, 6) as scale from d""")
def robust_scaling(spark, sf_dir):
    found = statistics.robust_scale(_long(spark, sf_dir), "pos", "v")
    return found.select("pos", r6("center").alias("center"), r6("scale").alias("scale"))


@query(_LONG + " select label, pos::bigint as pos, round(median(v), 6) as mid, round(quantile_cont(v, 0.1), 6) as low, round(quantile_cont(v, 0.9), 6) as high from l group by all")
def landcover_percentiles(spark, sf_dir):
    rows = quantiles(_long(spark, sf_dir), ["label", "pos"], "v", [0.5, 0.1, 0.9])
    return rows.select("label", "pos", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(["mid", "low", "high"])])


@query(_LONG + """, s as (select label, source, pos, avg(v) as m from l group by all)
select a.label, a.source, a.pos::bigint as pos, round(avg(b.m), 6) as template from s a join s b on b.label = a.label and b.pos = a.pos and b.source <> a.source group by all""")
def template_curve(spark, sf_dir):
    """Mean over the other sources of their means: the total of a group less its own, no self-join."""
    mean = _long(spark, sf_dir).groupBy("label", "source", "pos").agg(F.avg("v").alias("m"))
    w = Window.partitionBy("label", "pos")
    others = F.count("*").over(w) - 1
    out = mean.withColumn("others", others).withColumn("total", F.sum("m").over(w)).where("others > 0")
    return out.select("label", "source", "pos", r6((F.col("total") - F.col("m")) / F.col("others")).alias("template"))


@query(_LONG.replace("select label", "select vec_id, label", 1) + """, c as (select label, pos, avg(v) as m from l group by all),
d as (select vec_id, label, sqrt(sum((v - m) ** 2)) as distance from l join c using (label, pos) group by vec_id, label),
k as (select label, median(distance) as mid, quantile_cont(distance, 0.99) as p99 from d group by all),
t as (select label, greatest(p99, mid + 4 * 1.4826 * median(abs(distance - mid)), 1e-6) as threshold from d join k using (label) group by label, mid, p99)
select vec_id, label, round(distance, 6) as distance, round(threshold, 6) as threshold, round(distance / threshold, 6) as score from d join t using (label)""")
def cluster_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    center = rows.groupBy("label", "pos").agg(F.avg("v").alias("m"))
    off = rows.join(center, ["label", "pos"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) ** 2)).alias("distance"))
    found = statistics.cluster_outliers(off, "label", "distance")
    return found.select("vec_id", "label", r6("distance").alias("distance"), r6("threshold").alias("threshold"), r6("score").alias("score"))


@query()
def pca_kmeans(spark, sf_dir):
    """Three principal components, clusters in them, and each row's outlier score."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    center, components = statistics.principal_components(rows, "embedding")
    found = statistics.kmeans(statistics.project(rows, "embedding", center, components), "scores", 8, seed=0)
    return statistics.cluster_outliers(found, "cluster", "distance").select("vec_id", "cluster", "distance", "threshold", "score")


#: Vectors with some elements blanked, for the repairs.
_GAPPY = "with g as (select vec_id, list_transform(range(1, len(embedding) + 1), lambda i: case when (i * 7 + vec_id) % 11 <> 0 or i % 4 = 0 then embedding[i]::double end) as y from embeddings)"


def _gappy(spark, sf_dir):
    blank = F.transform("embedding", lambda v, i: F.when((((i + 1) * 7 + F.col("vec_id")) % 11 != 0) | ((i + 1) % 4 == 0), v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", blank.alias("y"))


@query(_GAPPY + """, p as (select vec_id, unnest(y) as v, unnest(range(len(y))) as pos from g),
f as (select *, last_value(case when v is not null then pos end ignore nulls) over a as lp, last_value(v ignore nulls) over a as lv,
    first_value(case when v is not null then pos end ignore nulls) over b as np, first_value(v ignore nulls) over b as nv from p
    window a as (partition by vec_id order by pos rows between unbounded preceding and current row), b as (partition by vec_id order by pos rows between current row and unbounded following)),
i as (select vec_id, count(*) filter (where v is null and lp is not null and np is not null) as missing, max(case when v is null and lp is not null and np is not null then np - lp - 1 else 0 end) as run, count(v) as known from f group by all)
select vec_id, pos::bigint as pos, round(case when v is not null then v when lp is null then nv when np is null then lv else lv + (nv - lv) * (pos - lp) / (np - lp) end, 6) as value
from f join i using (vec_id) where known >= 2 and missing <= 8 and run <= 8""")
def gap_repair(spark, sf_dir):
    """Build-time gap repair; series with too many gaps are refused."""
    found = series.mapped(_gappy(spark, sf_dir), "y", S.fill_gaps).where("values is not null")
    return found.select("vec_id", F.posexplode("values").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@query("""select vec_id, round(list_max(list_transform(range(4, len(embedding) - 2), lambda i: abs(embedding[i]::double - (embedding[i - 3]::double + embedding[i + 3]::double) / 2))), 6) as deviation from embeddings where len(embedding) > 6""")
def local_deviation(spark, sf_dir):
    """Largest distance from the line between the values three places away."""
    at = F.sequence(F.lit(4), F.size("embedding") - 3)
    y = lambda i: F.element_at("embedding", i).cast("double")
    off = F.transform(at, lambda i: F.abs(y(i) - (y(i - 3) + y(i + 3)) / 2))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 6).select("vec_id", r6(F.array_max(off)).alias("deviation"))


@query()
def spike_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return series.mapped(rows, "embedding", partial(S.flatten_spikes, lo=16, hi=48, pad=3, threshold=0.1)).select("vec_id", "values")


_PLACES = "with p as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings)"


def _by_place(df):
    return df.select("vec_id", F.posexplode("values").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), (r6("value") + 0).alias("value"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"), F.lit("x").alias("source_id"))


@query(_PLACES + """, f as (select vec_id, regr_slope(v, pos) as s, regr_intercept(v, pos) as i from p where pos between 40 and 55 group by all), d as (select vec_id, max(abs(v - (s * pos + i))) as drift from p join f using (vec_id) where pos >= 56 group by all)
select vec_id, pos::bigint as pos, round(case when pos >= 56 and drift >= 0.05 then s * pos + i else v end, 6) + 0 as value from p join f using (vec_id) join d using (vec_id)""")
def tail_repair(spark, sf_dir):
    """The line through the 16 values before place 56 goes on where the tail leaves it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _by_place(series.mapped(rows, "embedding", partial(S.extend_tail, start=56, fit=16, threshold=0.05)))


@query(_PLACES + """, s as (select vec_id, avg(v) filter (where pos between 5 and 12) as y0, avg(v) filter (where pos between 44 and 50) as y1 from p group by all),
l as (select *, y0 + (y1 - y0) * (pos - 8.5) / 38.5 as line from p join s using (vec_id)), t as (select vec_id, max(v - line) as rise from l where pos between 20 and 35 group by all),
w as (select *, greatest(0, least(1, case when pos > 31 then (39 - pos) / 8 else (pos - 16) / 8 end)) as w from l join t using (vec_id))
select vec_id, pos::bigint as pos, round(case when rise >= 0.01 then (1 - w) * v + w * line else v end, 6) + 0 as value from w""")
def window_bridge(spark, sf_dir):
    """A window that rises over the line between its shoulders takes the line, faded in and out on ramps."""
    rule = R.Bridge("window", (420, 435), (405, 412), (444, 450), half=4, rise=0.01, clip=None)
    return _by_place(repairs.repaired(_vectors(spark, sf_dir), [repairs.bridge("", rule)]))


@query(_PLACES + """, a as (select vec_id, max(v) filter (where pos = 10) as y0, max(v) filter (where pos = 17) as y1 from p group by all)
select vec_id, pos::bigint as pos, round(case when pos between 10 and 16 then y0 + (y1 - y0) * (pos - 10) / 7 else v end, 6) + 0 as value from p join a using (vec_id)""")
def edge_bridge(spark, sf_dir):
    rule = repairs.Rule("edge", "", partial(R.edge_bridge, start=410, end=416, anchor=417))
    return _by_place(repairs.repaired(_vectors(spark, sf_dir), [rule]))


_TEMPLATE = [0.1 + 0.01 * k + 0.002 * (k % 5) for k in range(64)]


@query(_PLACES + f""", t as (select unnest({_TEMPLATE}::double[]) as t, unnest(range(64)) as pos), a as (select vec_id, max(v) filter (where pos = 20) as y0, max(v) filter (where pos = 40) as y1 from p group by all)
select vec_id, pos::bigint as pos, round(case when pos between 25 and 40 then y0 + (y1 - y0) * (t - {_TEMPLATE[20]}) / {_TEMPLATE[40] - _TEMPLATE[20]} else v end, 6) + 0 as value from p join a using (vec_id) join t using (pos)""")
def template_stretch(spark, sf_dir):
    """A window from a template that is stretched to meet the vector at both anchors."""
    rows = _vectors(spark, sf_dir).where("size(values) = 64").withColumn("landcover_group", F.lit("g"))
    return _by_place(repairs.templated(rows, np.array(_TEMPLATE), "x", "g", left=420, right=440, replace=(425, 440)))


@query(_GAPPY + """, p as (select vec_id, unnest(y) as v, unnest(range(len(y))) as pos from g),
k as (select *, v is null as m, min(case when v is not null then pos end) over (partition by vec_id) as a, max(case when v is not null then pos end) over (partition by vec_id) as b, count(*) over (partition by vec_id) as n from p),
r as (select *, m and pos > a and pos < b as within, pos - row_number() over (partition by vec_id, m order by pos) as run from k),
c as (select vec_id, max(c) as longest from (select vec_id, run, count(*) as c from r where within group by all) group by all)
select vec_id, count_if(m)::bigint as missing, max(a)::bigint as leading, (max(n) - 1 - max(b))::bigint as trailing, count_if(within)::bigint as internal, coalesce(max(longest), 0)::bigint as longest from r left join c using (vec_id) group by vec_id""")
def gap_report(spark, sf_dir):
    """Missing, leading, trailing and internal places of each series and its longest internal gap."""
    return series.gap_counts(_gappy(spark, sf_dir), "y").select("vec_id", "gaps.*")


@query("""select vec_id, round(list_max(list_transform(range(1, len(embedding)), lambda i: abs(embedding[i + 1]::double - embedding[i]::double))), 6) as max_abs_jump, round(list_min(embedding)::double, 6) as min_reflectance, round(list_max(embedding)::double, 6) as max_reflectance,
len(list_filter(embedding, lambda v: v::double < -0.05 or v::double > 1.05))::bigint as out_of_range_band_count, len(embedding)::bigint as valid_band_count from embeddings""")
def review_metrics(spark, sf_dir):
    """The metrics of a review that need no smoother."""
    m = review.metrics(_vectors(spark, sf_dir))
    return m.select("vec_id", *[r6(c).alias(c) for c in ("max_abs_jump", "min_reflectance", "max_reflectance")], "out_of_range_band_count", "valid_band_count")


_LABELS = ["X400", "nm_2500", "spc.350", "401.5 nm", "B2 at 865 of 20", "7", "99999", '"500"', "wl 1200 nanometer", "0700"]


@query(f"""with l as (select p_partkey, trim(({_LABELS!r})[p_partkey % {len(_LABELS)} + 1], '"') as s from part),
c as (select p_partkey, list_filter(list_transform(list_concat([nullif(regexp_extract(s, '(?i)^(?:x|wl|nm_)?(\\d+(?:\\.\\d+)?)$', 1), ''), nullif(regexp_extract(s, '(?i)^spc\\.?(\\d+(?:\\.\\d+)?)$', 1), ''), nullif(regexp_extract(s, '(?i)^(\\d+(?:\\.\\d+)?)\\s*(?:nm|nanometers?)?$', 1), '')],
  list_reverse(list_filter(regexp_extract_all(s, '\\d+(?:\\.\\d+)?'), lambda t: regexp_full_match(t, '\\d{{3,4}}(\\.\\d+)?')))), lambda t: t::double), lambda w: w between 100 and 3000) as found from l)
select p_partkey, found[1] as wavelength from c""")
def wavelength_labels(spark, sf_dir):
    """The wavelength that a header names."""
    sql_functions.register(spark)
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).selectExpr("p_partkey", "wavelength_label(label) as wavelength")


@query("""with e as (select vec_id, embedding::double[] as x from embeddings), a as (select a.vec_id, a.x, b.x as y, least(1, greatest(0, 0.25 + 0.35 * exp(-abs(a.x[1])) + 0.25 * exp(-abs(a.x[2])) + 0.15 * 0.5)) as c from e a join e b on b.vec_id = a.vec_id + 1 where len(a.x) = len(b.x))
select vec_id, round(sqrt(list_avg(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) ** 2))), 6) as distance, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i)) / list_sum(range(1, len(x) + 1)), 6) as average,
case when c >= 0.85 then 'high' when c >= 0.6 then 'medium' else 'low' end as band, round(c, 6) as score from a""")
def sql_function_calls(spark, sf_dir):
    """SQL functions, called from SQL."""
    sql_functions.register(spark)
    table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as x").createOrReplaceTempView("prismora_vectors")
    return spark.sql("""with a as (select a.vec_id, a.x, b.x as y, confidence_score(1d, abs(a.x[0]), abs(a.x[1]), 0.5d, 1d) as c from prismora_vectors a join prismora_vectors b on b.vec_id = a.vec_id + 1 where size(a.x) = size(b.x))
select vec_id, round(rms_distance(x, y), 6) as distance, round(srf_average(x, transform(sequence(1, size(x)), i -> cast(i as double))), 6) as average, confidence_band(c) as band, round(c, 6) as score from a""")


@query()
def whittaker_smooth(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return series.mapped(rows, "embedding", lambda y: smooth(y)[0], whole=True).select("vec_id", "values")


@query()
def outlier_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return series.mapped(rows, "embedding", partial(S.replace_outliers, threshold=0.05), whole=True).select("vec_id", "values")


@query("""select l_returnflag, count(*) filter (where l_shipdate <= timestamp '1994-06-01' or l_quantity >= 40)::bigint as kept, round(avg((l_shipdate <= timestamp '1994-06-01' or l_quantity >= 40)::int), 6) as kept_fraction from lineitem group by all""")
def native_range_filter(spark, sf_dir):
    keep = (F.col("l_shipdate") <= F.to_timestamp(F.lit("1994-06-01"))) | (F.col("l_quantity") >= 40)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(keep).alias("kept"), r6(F.avg(keep.cast("int"))).alias("kept_fraction"))


@query("""select p_partkey, try_cast(replace(regexp_replace(trim(s), '\\s*%$', ''), ',', '.') as double) as number, case when p_size % 3 = 0 then true when p_size % 3 = 1 then false end as flag
from (select *, case p_size % 4 when 0 then 'n/a' when 1 then p_size || ',5 %' when 2 then p_size || ' %' else p_size::varchar end as s from part)""")
def parse_cells(spark, sf_dir):
    size = F.col("p_size")
    cell = F.when(size % 4 == 0, "n/a").when(size % 4 == 1, F.concat(size, F.lit(",5 %"))).when(size % 4 == 2, F.concat(size, F.lit(" %"))).otherwise(size.cast("string"))
    word = F.when(size % 3 == 0, " Yes").when(size % 3 == 1, "F").otherwise("maybe")
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_number(cell).alias("number"), S.parse_flag(word).alias("flag"))
