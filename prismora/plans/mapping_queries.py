"""Queries of the mapper and its fits on a stand-in library, and their SQL; registered in the catalogue.

The vectors of the embeddings table are the spectra: a grid of 64 places, two segments that overlap, a source sensor of
three bands (the middle one bridges the segments) and a target of two.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..grid import Grid
from ..mapping import benchmark, linear
from ..mapping.mapper import Mapper
from ..mapping.prepare import prepared
from ..operators import ann
from ..sources.sensors import Band, Sensor
from .catalogue import K, asked, library, query, r6, table

GRID = Grid(0, 63, (0, 39), (24, 63), (24, 39))


def triangle(band_id: str, segment: str, center: int, half: int) -> Band:
    places = range(center - half, center + half + 1)
    return Band(band_id, segment, tuple(map(float, places)), tuple(1 - abs(k - center) / half for k in places))


SOURCE = Sensor("source", (triangle("a", "vnir", 10, 4), triangle("nir", "vnir", 30, 4), triangle("s", "swir", 50, 8)))
TARGET = Sensor("target", (triangle("t1", "vnir", 20, 6), triangle("t2", "swir", 45, 6)))
NARROW = Sensor("narrow", (triangle("a", "vnir", 10, 4),))
ALIKE = Sensor("alike", (triangle("t1", "vnir", 20, 6), triangle("t3", "vnir", 14, 3)))


def _rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return e.select(F.col("vec_id").alias("row_index"), name("src", F.col("vec_id") % 7).alias("source_id"), name("s", F.col("vec_id")).alias("spectrum_id"), name("n", F.floor(F.col("vec_id") / 3)).alias("sample_name"), F.col("embedding").cast("array<double>").alias("values"))


def mapper(spark, sf_dir) -> Mapper:
    return Mapper(prepared(_rows(spark, sf_dir), [SOURCE, TARGET, NARROW, ALIKE], GRID))


def batch(spark, sf_dir, m: Mapper, masked: bool = False, own: bool = False):
    """Every twentieth vector's simulated source bands, 2 % up; masked: some bands of some samples are not valid."""
    x = m.library.simulated(SOURCE).where("row_index % 20 = 0").join(m.library.library.select("row_index", "row_id"), "row_index")
    ok = F.array(F.col("row_index") % 60 != 0, F.lit(True), F.col("row_index") % 40 != 0) if masked else F.array(*[F.lit(True)] * 3)
    row = F.col("row_id") if own else F.lit(None).cast("string")
    sample = F.concat(F.lit("n"), F.floor(F.col("row_index") / 3).cast("string"))
    return x.select(F.col("row_index").alias("sample_index"), sample.alias("sample_id"), F.transform("x", lambda v: v * 1.02).alias("values"), ok.alias("valid"), row.alias("exclude_row_id"))


def _band(b: Band) -> str:
    w = b.weights(GRID).tolist()
    return f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * ({w}::double[])[i]))"


def _sql(masked: bool = False, where: str = "true", least: int = 1) -> str:
    """f: bands of all rows; q: queries with flags; v, s: the k nearest of each segment; fv, fs: fit and confidence."""
    ok = ("(vec_id % 60 <> 0)::int", "(vec_id % 40 <> 0)::int") if masked else ("1", "1")
    bands = ", ".join(f"{_band(b)} as {n}" for b, n in zip([*SOURCE.bands, *TARGET.bands], ("a", "n", "s", "t1", "t2")))
    near = lambda x, ox: f"sqrt(({ox} * ({x} * 1.0 - q{x}) ** 2 + (n - qn) ** 2) / nullif({ox} + 1, 0))"

    def segment(x: str, ox: str) -> str:
        fit = f"sqrt(({ox} * (avg({x}) - q{x}) ** 2 + (avg(n) - qn) ** 2) / ({ox} + 1))"
        scale = f"(({ox} * abs(q{x}) + abs(qn)) / ({ox} + 1))"
        score = f"least(1, greatest(0, 0.25 * ({ox} + 1) / 2.0 + 0.35 * exp(-avg(d) / {scale}) + 0.25 * exp(-{fit} / {scale}) + 0.15 * max(1.0 / k)))"
        return f"""{x}n as (select *, count(*) over (partition by qid) as k from (select qid, vec_id, a, n, s, t1, t2, qa, qn, qs, oka, oks, {near(x, ox)} as d, row_number() over (partition by qid order by {near(x, ox)}, vec_id) as rank from q, f where {where} and {ox} + 1 >= {least}) where rank <= {K}),
{x}f as (select qid, {ox} + 1 as n, {fit} as rmse, {score} as c, avg(t1) as t1, avg(t2) as t2 from {x}n group by qid, qa, qn, qs, oka, oks)"""

    return f"""with f as (select vec_id, {bands} from embeddings where len(embedding) = 64),
q as (select vec_id as qid, a * 1.02 as qa, n * 1.02 as qn, s * 1.02 as qs, {ok[0]} as oka, {ok[1]} as oks from f where vec_id % 20 = 0),
{segment('a', 'oka')}, {segment('s', 'oks')},
outcome as (select q.qid, af.t1 as t1, sf.t2 as t2, case when af.n is null and sf.n is null then null else (coalesce(af.n * af.rmse, 0) + coalesce(sf.n * sf.rmse, 0)) / (coalesce(af.n, 0) + coalesce(sf.n, 0)) end as rmse,
  case when af.n is null and sf.n is null then null else (coalesce(af.n * af.c, 0) + coalesce(sf.n * sf.c, 0)) / (coalesce(af.n, 0) + coalesce(sf.n, 0)) end as c from q left join af on af.qid = q.qid left join sf on sf.qid = q.qid)"""


def _flat(results):
    return results.select("sample_index", "sample_id", r6(F.col("reflectance")[0]).alias("t1"), r6(F.col("reflectance")[1]).alias("t2"), r6("source_fit_rmse").alias("source_fit_rmse"), r6("confidence").alias("confidence"), "level", "policy")


_OUT = """ select qid as sample_index, 'n' || (qid // 3) as sample_id, round(t1, 6) as t1, round(t2, 6) as t2, round(rmse, 6) as source_fit_rmse, round(c, 6) as confidence,
case when c is null then 'unavailable' when c >= 0.85 then 'high' when c >= 0.6 then 'medium' else 'low' end as level, case when c >= 0.85 then 'accept' when c >= 0.6 then 'manual_review' else 'reject' end as policy from outcome"""


@query(_sql() + _OUT)
def map_target(spark, sf_dir):
    """Source bands to the target's, each segment by its own neighbours."""
    m = mapper(spark, sf_dir)
    return _flat(m.map_batch(batch(spark, sf_dir, m), "source", target="target", k=K))


@query(_sql(masked=True) + _OUT)
def map_masked_confidence(spark, sf_dir):
    """Bands that are not valid count neither in distances nor in the fit, and lower the coverage."""
    m = mapper(spark, sf_dir)
    return _flat(m.map_batch(batch(spark, sf_dir, m, masked=True), "source", target="target", k=K))


@query(_sql(masked=True, least=2) + _OUT)
def map_min_valid(spark, sf_dir):
    """Two valid bands at least in a segment: the target's band of a segment that fails is null, its sample has the other."""
    m = mapper(spark, sf_dir)
    return _flat(m.map_batch(batch(spark, sf_dir, m, masked=True), "source", target="target", k=K, min_valid_bands=2))


@query(_sql(where="vec_id // 3 <> qid // 3") + _OUT)
def map_excluded(spark, sf_dir):
    """A sample's own row, and all rows of its sample name, are no candidates."""
    m = mapper(spark, sf_dir)
    return _flat(m.map_batch(batch(spark, sf_dir, m, own=True), "source", target="target", k=K, self_exclude=True))


@query(_sql(where="vec_id % 5 <> 0 and vec_id % 7 <> 3") + _OUT)
def map_candidates(spark, sf_dir):
    """Only some rows are candidates, given by row and less the names that are excluded."""
    m = mapper(spark, sf_dir)
    rows = m.library.library.where("row_index % 5 <> 0 and source_id <> 'src3'").select("row_index")
    return _flat(m.map_batch(batch(spark, sf_dir, m), "source", target="target", k=K, candidates=rows))


@query(_sql() + """, lib as (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as pos from embeddings where len(embedding) = 64),
av as (select qid, pos, avg(x) as v from an join lib using (vec_id) where pos <= 39 group by all), sv as (select qid, pos, avg(x) as v from sn join lib using (vec_id) where pos >= 24 group by all)
select coalesce(av.qid, sv.qid) as sample_index, coalesce(av.pos, sv.pos)::bigint as pos, round(case when sv.v is null then av.v when av.v is null then sv.v else (39 - av.pos) / 15.0 * av.v + (av.pos - 24) / 15.0 * sv.v end, 6) as value
from av full join sv on av.qid = sv.qid and av.pos = sv.pos""")
def map_full(spark, sf_dir):
    """The whole spectrum: both segments' neighbours, blended where they overlap."""
    m = mapper(spark, sf_dir)
    found = m.map_batch(batch(spark, sf_dir, m), "source", "full_spectrum", k=K)
    rows = found.select("sample_index", F.posexplode("reflectance").alias("pos", "value"))
    return rows.select("sample_index", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


def _review(x: str, name: str, near: str, own: str) -> str:
    ids = "'src' || (vec_id % 7) as source_id, 's' || vec_id as spectrum_id, 'n' || (vec_id // 3) as sample_name"
    return f"""select q.qid as sample_index, 'n' || (q.qid // 3) as sample_id, '{name}' as segment, case when {x}f.n is null then 'insufficient_valid_bands' else 'ok' end as status, (q.{own} + 1)::bigint as valid_band_count,
round({x}f.rmse, 6) as source_fit_rmse, round(coalesce({x}f.c, 0), 6) as confidence, rank::double as neighbor_rank, case when vec_id is not null then 'src' || (vec_id % 7) || ':s' || vec_id || ':n' || (vec_id // 3) end as neighbor_id,
{ids}, round(d, 6) as neighbor_distance, round(1.0 / k, 6) as neighbor_weight from q left join {x}f on {x}f.qid = q.qid left join {x}n on {x}n.qid = q.qid"""


@query(_sql(masked=True, least=2) + " " + _review("a", "vnir", "an", "oka") + " union all " + _review("s", "swir", "sn", "oks"))
def neighbor_review_table(spark, sf_dir):
    """A row per sample, segment and neighbour; a segment that fails has one row without a rank."""
    m = mapper(spark, sf_dir)
    found = m.map_batch(batch(spark, sf_dir, m, masked=True), "source", target="target", k=K, min_valid_bands=2, diagnostics=True)
    rows = m.neighbor_review(found)
    return rows.select("sample_index", "sample_id", "segment", "status", F.col("valid_band_count").cast("long").alias("valid_band_count"), r6("source_fit_rmse").alias("source_fit_rmse"), r6("confidence").alias("confidence"), F.col("neighbor_rank").cast("double").alias("neighbor_rank"), "neighbor_id", "source_id", "spectrum_id", "sample_name", r6("neighbor_distance").alias("neighbor_distance"), r6("neighbor_weight").alias("neighbor_weight"))


_S11, _S22, _S12 = "var_pop(a)", "var_pop(s)", "covar_pop(a, s)"


@query(f"with f as (select {_band(SOURCE.bands[0])} as a, {_band(SOURCE.bands[2])} as s, {_band(TARGET.bands[0])} as t1, {_band(TARGET.bands[1])} as t2 from embeddings where len(embedding) = 64),\n" + " union all ".join(
    f"select '{t}' as output, round(wa, 6) as wa, round(ws, 6) as ws, round(my - wa * ma - ws * ms, 6) as bias from (select ({_S22} * covar_pop(a, {t}) - {_S12} * covar_pop(s, {t})) / ({_S11} * {_S22} - {_S12} ** 2) as wa, ({_S11} * covar_pop(s, {t}) - {_S12} * covar_pop(a, {t})) / ({_S11} * {_S22} - {_S12} ** 2) as ws, avg({t}) as my, avg(a) as ma, avg(s) as ms from f)"
    for t in ("t1", "t2")
))
def linear_compile(spark, sf_dir):
    """Normal equations of two inputs and two outputs."""
    m = mapper(spark, sf_dir)
    x = m.library.simulated(SOURCE, [0, 2]).select("row_index", "x")
    fit = linear.fit(x.join(m.library.simulated(TARGET).select("row_index", F.col("x").alias("y")), "row_index"))
    rows = [(t, float(fit.weights[0, k]), float(fit.weights[1, k]), float(fit.bias[k])) for k, t in enumerate(("t1", "t2"))]
    made = spark.createDataFrame(rows, "output string, wa double, ws double, bias double")
    return made.select("output", *[r6(c).alias(c) for c in ("wa", "ws", "bias")])


_SPLIT = "t as (select vec_id from (select vec_id, row_number() over (order by md5(vec_id || ':0'), vec_id) as r, count(*) over () as n from embeddings where len(embedding) = 64) where r <= least(greatest(1, ceil(n * {0})), n - 1, {1}))"


@query("with " + _SPLIT.format(0.2, 10**9) + " select vec_id, case when vec_id in (select vec_id from t) then 'test' else 'train' end as part from embeddings where len(embedding) = 64")
def holdout_split(spark, sf_dir):
    """ceil(n * 0.2) rows by the least MD5 of row and seed: the same on each run, for any number of rows."""
    rows = _rows(spark, sf_dir).select(F.col("row_index").alias("vec_id"))
    test = benchmark.hashed_split(rows, "vec_id", 0.2).withColumn("part", F.lit("test"))
    return rows.join(test, "vec_id", "left").select("vec_id", F.coalesce("part", F.lit("train")).alias("part"))


@query("with " + _SPLIT.format(0.1, 60) + f""",
f as (select vec_id, {_band(NARROW.bands[0])} as a, {_band(ALIKE.bands[0])} as t0, {_band(ALIKE.bands[1])} as t1, vec_id in (select vec_id from t) as test from embeddings where len(embedding) = 64),
nb as (select q.vec_id as qid, q.t0 as y0, q.t1 as y1, f.t0, f.t1 from f q, f where q.test and not f.test qualify row_number() over (partition by q.vec_id order by abs(q.a - f.a), f.vec_id) <= {K}),
r as (select avg(t0) - y0 as e0, avg(t1) - y1 as e1 from nb group by qid, y0, y1),
c as (select regr_slope(t0, a) as s0, regr_intercept(t0, a) as i0, regr_slope(t1, a) as s1, regr_intercept(t1, a) as i1 from f where not test),
o as (select s0 * a + i0 - t0 as e0, s1 * a + i1 - t1 as e1 from f, c where test),
u as (select 'retrieval' as method, 0 as band, e0 as e from r union all select 'retrieval', 1, e1 from r union all select 'regression', 0, e0 from o union all select 'regression', 1, e1 from o)
select method, band::bigint as band, count(*)::bigint as n, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(avg(e), 6) as bias from u group by all""")
def holdout_benchmark(spark, sf_dir):
    """Held-out rows' target bands by retrieval from the others and by least squares."""
    m = mapper(spark, sf_dir)
    test = benchmark.hashed_split(m.library.library, "row_index", 0.1, 60)
    x = m.library.simulated(NARROW).join(test, "row_index").select(F.col("row_index").alias("sample_index"), F.col("row_index").cast("string").alias("sample_id"), F.col("x").alias("values"))
    truth = m.library.simulated(ALIKE).join(test, "row_index").select(F.col("row_index").alias("sample_index"), F.col("x").alias("truth"))
    train = m.library.library.join(test, "row_index", "left_anti").select("row_index")
    made = m.map_batch(x, "narrow", target="alike", k=K, candidates=train).select("sample_index", F.col("reflectance").alias("made"))
    fitted = m.compile_linear("narrow", target="alike", rows=train).apply(x, "values", "made").select("sample_index", "made")
    parts = [benchmark.metrics(df.join(truth, "sample_index")).select(F.lit(n).alias("method"), "*") for n, df in (("retrieval", made), ("regression", fitted))]
    both = parts[0].unionByName(parts[1])
    return both.select("method", "band", "n", *[r6(c).alias(c) for c in ("rmse", "mae", "bias")])


@query()
def knn_approx(spark, sf_dir):
    """Neighbours from the nearest third of the cells of an index of all rows; its recall is tested against the exact join."""
    index = ann.build(library(spark, sf_dir).select("row_id", "x"))
    cells = len(index.centers)
    found = ann.knn(asked(spark, sf_dir).select("query_id", "q"), index, K, ann.probes_for("faiss", cells, K))
    return found.withColumn("distance", r6("distance"))


@query()
def qualification_grid(spark, sf_dir):
    """Summaries of a setting, with the metrics that are over their limits."""
    m = mapper(spark, sf_dir)
    test = benchmark.hashed_split(m.library.library, "row_index", 0.05, 20)
    return benchmark.grid(m, [("source", "target")], ["mean"], ["numpy"], [3], {"mean_rmse": 1e-6}, test=test)
