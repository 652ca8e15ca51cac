"""Queries of the driver contract and their SQL. Doubles are rounded to 6 places, integers are long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..mapping import retrieval
from ..mapping.benchmark import metrics
from ..operators import estimators as E
from ..operators.knn import knn
from ..operators.quantiles import median_and_mad, quantiles
from ..streaming.mapping import map_stream, shared_folder

K = 5
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"), "label")


def asked(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    valid = F.transform("embedding", lambda v, i: (i + F.col("vec_id")) % 3 != 0) if masked else F.lit(None).cast("array<boolean>")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), valid.alias("valid"))


def neighbors(spark: SparkSession, sf_dir: str, own: bool = True, masked: bool = False) -> DataFrame:
    return knn(asked(spark, sf_dir, masked), library(spark, sf_dir), K, exclude_own=own)


def found(spark: SparkSession, sf_dir: str, estimator: str) -> DataFrame:
    """Queries with their neighbours, weights, fit and reconstruction in one struct, without a shuffle."""
    rows = asked(spark, sf_dir)
    width = rows.select(F.size("q")).first()[0]
    none = F.lit(None).cast("long")
    given = rows.select(F.col("query_id").alias("sample_index"), F.col("q").cast("array<double>").alias("q"), "valid", F.col("query_id").alias("exclude_row"), none.alias("exclude_name"))
    lib = library(spark, sf_dir).select(F.col("row_id").alias("row_index"), none.alias("name_code"), F.col("x").cast("array<double>").alias("x"))
    made = retrieval.retrieve(given, "f", lib, lib.select("row_index", F.col("x").alias("y")), list(range(width)), K, estimator=estimator, rows=lib.count(), width=width)
    return made.where("f.ok").select(F.col("sample_index").alias("query_id"), "f.*")


def by_place(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.posexplode("values").alias("pos", "value")).select("query_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


def _knn_sql(where: str = "true", keep: str = "true") -> str:
    """keep: condition on the 1-based position i of a band."""
    return f"""
qs as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
ds as (
    select query_id, vec_id as row_id, sqrt(list_avg(list_transform(list_filter(range(1, len(q) + 1), lambda i: {keep}), lambda i: (q[i]::double - embedding[i]::double) * (q[i]::double - embedding[i]::double)))) as distance
    from qs, embeddings where {where}
),
nb as (select query_id, row_number() over (partition by query_id order by distance, row_id) as rank, row_id, distance from ds qualify rank <= {K})"""


_NB = "with " + _knn_sql("vec_id <> query_id")
_IDW = _NB + """, ex as (select *, max((distance <= 1e-12)::int) over (partition by query_id) as hit from nb),
raw as (select *, case when hit = 1 then (distance <= 1e-12)::double else 1 / distance end as raw from ex),
wt as (select query_id, rank, row_id, distance, raw / sum(raw) over (partition by query_id) as weight from raw)"""
_POS = ", lib as (select vec_id as row_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as pos from embeddings)"


@query("with " + _knn_sql() + " select query_id, rank, row_id, round(distance, 6) as distance from nb")
def knn_exact(spark, sf_dir):
    return neighbors(spark, sf_dir, own=False).withColumn("distance", r6("distance"))


@query("with " + _knn_sql("true", "(i - 1 + query_id) % 3 <> 0") + " select query_id, rank, row_id, round(distance, 6) as distance from nb")
def knn_masked(spark, sf_dir):
    return neighbors(spark, sf_dir, own=False, masked=True).withColumn("distance", r6("distance"))


@query(_NB + " select query_id, rank, row_id, round(distance, 6) as distance from nb")
def knn_excluded(spark, sf_dir):
    return neighbors(spark, sf_dir).withColumn("distance", r6("distance"))


@query("with " + _knn_sql() + _POS + " select query_id, pos::bigint as pos, round(avg(v), 6) as value from nb join lib using (row_id) group by all")
def streamed_mapping(spark, sf_dir):
    """The embeddings, a file or a folder of files, as a stream, mapped a chunk at a time; the query's own row is not left out."""
    rows = table(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a stream takes a file by a pattern only
    stream = stream.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(None).cast("array<boolean>").alias("valid"))
    folder = shared_folder(spark)
    map_stream(stream, library(spark, sf_dir), f"{folder}/rows", f"{folder}/checkpoint", K).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("query_id", "pos", r6("value").alias("value"))


@query(_NB + _POS + " select query_id, pos::bigint as pos, round(avg(v), 6) as value from nb join lib using (row_id) group by all")
def neighbors_mean(spark, sf_dir):
    return by_place(found(spark, sf_dir, "mean"))


@query(_IDW + _POS + " select query_id, pos::bigint as pos, round(sum(weight * v), 6) as value from wt join lib using (row_id) group by all")
def neighbors_idw(spark, sf_dir):
    return by_place(found(spark, sf_dir, "distance_weighted_mean"))


@query()
def neighbors_simplex(spark, sf_dir):
    """Mixture weights; they have no SQL and are tested against a direct search for the least distance."""
    near = F.arrays_zip(F.col("rows").alias("row_id"), "distances", "weights")
    rows = found(spark, sf_dir, "simplex_mixture").select("query_id", F.posexplode(near).alias("at", "n"))
    return rows.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("n.row_id").alias("row_id"), r6("n.distances").alias("distance"), r6("n.weights").alias("weight"))


@query(_IDW + _POS + """, rec as (select query_id, pos, sum(weight * v) as value from wt join lib using (row_id) group by all),
fit as (select r.query_id, sqrt(avg((r.value - l.v) ** 2)) as rmse, avg(abs(l.v)) as s from rec r join lib l on l.row_id = r.query_id and l.pos = r.pos group by all),
nr as (select query_id, avg(distance) as d, max(weight) as top from wt group by all),
sc as (select query_id, rmse, least(1, greatest(0, 0.25 + 0.35 * exp(-d / s) + 0.25 * exp(-rmse / s) + 0.15 * top)) as c from fit join nr using (query_id))
select query_id, round(rmse, 6) as source_fit_rmse, round(c, 6) as confidence, case when c >= 0.85 then 'high' when c >= 0.6 then 'medium' else 'low' end as level,
       case when c >= 0.85 then 'accept' when c >= 0.6 then 'manual_review' else 'reject' end as policy from sc""")
def confidence_policy(spark, sf_dir):
    rows = E.policy(found(spark, sf_dir, "distance_weighted_mean").withColumnRenamed("rmse", "source_fit_rmse"))
    return rows.select("query_id", r6("source_fit_rmse").alias("source_fit_rmse"), r6("confidence").alias("confidence"), "level", "policy")


@query(_NB + " select query_id, 'all' as segment, rank, row_id, label::bigint as label, round(distance, 6) as distance from nb join embeddings on vec_id = row_id")
def neighbor_review(spark, sf_dir):
    rows = neighbors(spark, sf_dir).join(library(spark, sf_dir).select("row_id", F.col("label").cast("long").alias("label")), "row_id")
    return rows.select("query_id", F.lit("all").alias("segment"), "rank", "row_id", "label", r6("distance").alias("distance"))


#: Responses of two toy bands over the vector's positions: triangles about 10 and 40.
BANDS = {"a": [max(0.0, 1 - abs(k - 10) / 4) for k in range(64)], "b": [max(0.0, 1 - abs(k - 40) / 8) for k in range(64)]}


def _band_sql(name: str) -> str:
    w = BANDS[name]
    return f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * ({w}::double[])[i])) / {sum(w)}"


@query(f"select vec_id, round({_band_sql('a')}, 6) as band_a, round({_band_sql('b')}, 6) as band_b from embeddings")
def band_simulation(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[r6(E.weighted_average(F.col("embedding"), w)).alias(f"band_{n}") for n, w in BANDS.items()])


@query("""with l as (select vec_id, unnest(embedding)::double as x, unnest(list_reverse(embedding))::double as y, unnest(range(len(embedding))) as pos from embeddings)
select vec_id, pos::bigint as pos, round(case when pos < 24 then x when pos > 39 then y else (39 - pos) / 15.0 * x + (1 - (39 - pos) / 15.0) * y end, 6) as value from l""")
def full_blend(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("x"), F.reverse("embedding").alias("y"))).alias("pos", "p"))
    value = E.blend(F.col("p")["x"].cast("double"), F.col("p")["y"].cast("double"), F.col("pos"), 24, 39)
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(value).alias("value"))


@query(_NB + _POS + f""", rec as (select query_id, pos, avg(v) as v from nb join lib using (row_id) group by all)
select query_id, round(sum(v * ({BANDS['a']}::double[])[pos + 1]) / {sum(BANDS['a'])}, 6) as band_a, round(sum(v * ({BANDS['b']}::double[])[pos + 1]) / {sum(BANDS['b'])}, 6) as band_b from rec group by all""")
def target_projection(spark, sf_dir):
    rec = found(spark, sf_dir, "mean")
    return rec.select("query_id", *[r6(E.weighted_average(F.col("values"), w)).alias(f"band_{n}") for n, w in BANDS.items()])


@query(_NB + _POS + """, rec as (select query_id, pos, avg(v) as v from nb join lib using (row_id) group by all),
e as (select r.pos, r.v - l.v as d from rec r join lib l on l.row_id = r.query_id and l.pos = r.pos)
select pos::bigint as pos, round(sqrt(avg(d * d)), 6) as rmse, round(avg(abs(d)), 6) as mae, round(avg(d), 6) as bias, round(abs(avg(d)), 6) as abs_bias from e group by all""")
def band_error_metrics(spark, sf_dir):
    truth = asked(spark, sf_dir).select("query_id", F.col("q").cast("array<double>").alias("truth"))
    pairs = found(spark, sf_dir, "mean").select("query_id", F.col("values").alias("made")).join(truth, "query_id")
    return metrics(pairs).select(F.col("band").alias("pos"), r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("bias").alias("bias"), r6(F.abs("bias")).alias("abs_bias"))


LINEAR = [((k * 7) % 11 - 5) / 10 for k in range(64)]


@query(f"select vec_id, round(0.5 + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * ({LINEAR}::double[])[i])), 6) as y from embeddings")
def linear_apply(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(E.linear_apply(F.col("embedding"), LINEAR, 0.5)).alias("y"))


def _long(spark, sf_dir) -> DataFrame:
    """label, source (vec_id % 7), pos, v of every vector element."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 7).alias("source"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("label", "source", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


_LONG = "with l as (select label::bigint as label, vec_id % 7 as source, unnest(range(len(embedding))) as pos, unnest(embedding)::double as v from embeddings)"


@query(_LONG + """, s as (select label, source, pos, avg(v) as m, count(*) as n from l group by all)
select 'source' as level, label, source, pos, round(m, 6) as value, n::bigint as spectra, 1::bigint as sources from s
union all select 'pooled', label, -1, pos, round(avg(v), 6), count(*), count(distinct source) from l group by label, pos
union all select 'balanced', label, -1, pos, round(avg(m), 6), sum(n)::bigint, count(*) from s group by label, pos""")
def prototypes(spark, sf_dir):
    rows = _long(spark, sf_dir)
    s = rows.groupBy("label", "source", "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.sum("v").alias("t"))
    cols = lambda level, source, value, n, k: [F.lit(level).alias("level"), "label", source.alias("source"), "pos", r6(value).alias("value"), n.alias("spectra"), k.alias("sources")]
    top = s.groupBy("label", "pos").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.avg("m").alias("m"), F.count("*").alias("k"))
    none = F.lit(-1).cast("long")
    return (
        s.select(*cols("source", F.col("source"), F.col("m"), F.col("n"), F.lit(1).cast("long")))
        .unionByName(top.select(*cols("pooled", none, F.col("t") / F.col("n"), F.col("n"), F.col("k"))))
        .unionByName(top.select(*cols("balanced", none, F.col("m"), F.col("n"), F.col("k"))))
    )


@query(_LONG + """, s as (select label, source, pos, avg(v) filter (where v > -1) as m, count(*) filter (where v > -1) as n from l group by all),
ok as (select label, source from s group by all having min(n) > 0)
select label, pos, round(avg(m), 6) as value, count(*)::bigint as sources from s join ok using (label, source) group by all""")
def common_support_curves(spark, sf_dir):
    some = F.when(F.col("v") > -1, F.col("v"))
    s = _long(spark, sf_dir).groupBy("label", "source", "pos").agg(F.avg(some).alias("m"), F.count(some).alias("n"))
    ok = s.groupBy("label", "source").agg(F.min("n").alias("least")).where("least > 0").select("label", "source")
    return s.join(ok, ["label", "source"]).groupBy("label", "pos").agg(r6(F.avg("m")).alias("value"), F.count("*").alias("sources"))


@query(_LONG + """, m as (select label, pos, avg(v) as m from l group by all), j as (select label, pos, lead(m) over (partition by label order by pos) - m as jump from m)
select label, pos, round(jump, 6) as jump, rank from (select *, row_number() over (partition by label order by abs(jump) desc, pos) as rank from j where jump is not null) where rank <= 5""")
def jump_decomposition(spark, sf_dir):
    m = _long(spark, sf_dir).groupBy("label", "pos").agg(F.avg("v").alias("m"))
    j = m.withColumn("jump", F.lead("m").over(Window.partitionBy("label").orderBy("pos")) - F.col("m")).where("jump is not null")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.abs("jump").desc(), "pos"))
    return j.withColumn("rank", rank.cast("long")).where("rank <= 5").select("label", "pos", r6("jump").alias("jump"), "rank")


@query("""with m as (select l_returnflag, median(l_extendedprice) as med from lineitem group by all),
d as (select l_returnflag, med, greatest(1.4826 * median(abs(l_extendedprice - med)), 1e-9) as mad from lineitem join m using (l_returnflag) group by all)
select l_returnflag, l_orderkey, l_linenumber::bigint as l_linenumber, round((l_extendedprice - med) / mad, 6) as z, rank from (
  select *, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem join d using (l_returnflag)) where rank <= 8""")
def robust_z_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    mad = median_and_mad(rows, ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.col("median").alias("med"), "mad")
    rank = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    top = rows.withColumn("rank", rank.cast("long")).where("rank <= 8")
    return top.join(F.broadcast(mad), "l_returnflag").select("l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), r6((F.col("l_extendedprice") - F.col("med")) / F.col("mad")).alias("z"), "rank")


@query("""select o_orderpriority, count(*)::bigint as n, round(greatest(case when count(*) < 1000 then quantile_cont(o_totalprice, 0.995) else quantile_cont(o_totalprice, 0.999) end, 250), 6) as threshold from orders group by all""")
def source_thresholds(spark, sf_dir):
    q = quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.995, 0.999])
    out = q.select("o_orderpriority", "n", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    return out.select("o_orderpriority", "n", r6(F.greatest(F.when(F.col("n") < 1000, F.col("a")).otherwise(F.col("b")), F.lit(250.0))).alias("threshold"))


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by all")
def ols_1d(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("with k as (select l_orderkey from lineitem group by all having count(*) / 7.0 >= 0.8) select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from k)")
def coverage_filter(spark, sf_dir):
    keep = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n / 7.0 >= 0.8").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(keep, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""select l_returnflag, count(*)::bigint as total, count(*) filter (where l_discount >= 0.05 and l_quantity < 10)::bigint as dropped,
count(distinct case when l_discount >= 0.05 and l_quantity < 10 then l_orderkey end)::bigint as orders_hit, round(1 - avg((l_discount >= 0.05 and l_quantity < 10)::int), 6) as kept_fraction from lineitem group by all""")
def subset_rules(spark, sf_dir):
    hit = (F.col("l_discount") >= 0.05) & (F.col("l_quantity") < 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("total"), F.count_if(hit).alias("dropped"), F.countDistinct(F.when(hit, F.col("l_orderkey"))).alias("orders_hit"), r6(1 - F.avg(hit.cast("int"))).alias("kept_fraction")
    )


@query("""select n_name, max(n_regionkey)::bigint as region, count(s_suppkey)::bigint as suppliers, coalesce(bool_or(s_acctbal < 0), false) as any_negative,
count(*) filter (where s_acctbal > 5000)::bigint as rich, round(greatest(coalesce(avg(s_acctbal), 0), 0), 6) as mean_balance from nation left join supplier on s_nationkey = n_nationkey group by all""")
def source_summary(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(
        F.max("n_regionkey").cast("long").alias("region"), F.count("s_suppkey").alias("suppliers"), F.coalesce(F.bool_or(F.col("s_acctbal") < 0), F.lit(False)).alias("any_negative"),
        F.count_if(F.col("s_acctbal") > 5000).alias("rich"), r6(F.greatest(F.coalesce(F.avg("s_acctbal"), F.lit(0.0)), F.lit(0.0))).alias("mean_balance"),
    )


@query("""select c_custkey, coalesce(o_orderstatus, 'not_fetched') as status, count(l_orderkey)::bigint as artifacts from customer left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by all""")
def build_status(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))  # before the join: one row an order
    orders = table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_custkey", "o_orderstatus", "n")
    rows = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_custkey", F.coalesce("o_orderstatus", F.lit("not_fetched")).alias("status")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("artifacts"))


@query("""select 'no_null' as variant, count(*)::bigint as n from orders where o_orderpriority not in (select * from (values ('1-URGENT'), ('5-LOW')))
union all select 'with_null', count(*) from orders where o_orderpriority not in (select * from (values ('1-URGENT'), (null)))""")
def null_aware_anti(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("prismora_orders")
    one = "select '{0}' as variant, count(*) as n from prismora_orders where o_orderpriority not in (select * from values ('1-URGENT'), ({1}))"
    return spark.sql(one.format("no_null", "'5-LOW'") + " union all " + one.format("with_null", "cast(null as string)"))


@query("select n_nationkey::bigint as n_nationkey, n_name from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 9000 union select c_nationkey from customer where c_acctbal > 9900)")
def manifest_semi_union(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    rows = table(spark, sf_dir, "nation").join(a.union(b).distinct(), "n_nationkey", "left_semi")
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("""with x as (select distinct l_partkey as k, 'returned' as reason from lineitem where l_returnflag = 'R' and l_quantity >= 49)
select k, reason, p_brand, coalesce(n, 0)::bigint as lines from x left join part on p_partkey = k left join (select l_partkey, count(*) as n from lineitem group by all) on l_partkey = k""")
def exclusion_audit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    x = items.where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("k"), F.lit("returned").alias("reason")).distinct()
    n = items.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("lines"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    return x.join(parts, "k", "left").join(n, "k", "left").select("k", "reason", "p_brand", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("select user_id, string_agg(concat(event_type, ':', n), ' | ' order by event_type) as parsers from (select user_id, event_type, count(*) as n from events group by all) group by all")
def parser_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda s: F.concat_ws(":", s["event_type"], s["n"].cast("string")))
    return n.groupBy("user_id").agg(F.array_join(parts, " | ").alias("parsers"))


_RUNS = """with c as (select *, coalesce((event_type <> lag(event_type) over w)::int, 1) as changed from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(changed) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c)"""


@query(_RUNS + " select user_id, run::bigint as run, any_value(event_type) as event_type, count(*)::bigint as n, round(avg(value), 6) as mean_value from r group by user_id, run")
def run_length_groups(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("changed", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("""select user_id, event_type, round(avg(value), 6) as value from events group by all""")
def wide_to_long(spark, sf_dir):
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # column names
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.avg("value"))
    return wide.unpivot("user_id", kinds, "event_type", "value").where("value is not null").withColumn("value", r6("value"))


@query("""select l_orderkey, round(max(case when l_linenumber = 1 then l_quantity end), 6) as q1, round(max(case when l_linenumber = 2 then l_quantity end), 6) as q2, round(max(case when l_linenumber = 3 then l_quantity end), 6) as q3 from lineitem group by all""")
def long_to_wide(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_quantity"))
    return rows.select("l_orderkey", *[r6(str(k)).alias(f"q{k}") for k in (1, 2, 3)])


@query("""with u as (select 0 as root, * from events union all select 1, * from events where event_id % 3 = 0)
select event_id, root::bigint as root, event_type from u qualify row_number() over (partition by event_id order by root, ts) = 1""")
def dedup_keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.withColumn("root", F.lit(0)).unionByName(e.where("event_id % 3 = 0").withColumn("root", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("root", "ts"))
    return u.withColumn("nth", first).where("nth = 1").select("event_id", F.col("root").cast("long").alias("root"), "event_type")


@query("select o_custkey, o_orderkey, printf('%s_%06d', 'source', row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)) as spectrum_id from orders")
def ordinal_ids(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.format_string("source_%06d", nth).alias("spectrum_id"))


@query("""with o as (select l_orderkey, max(abs(l_extendedprice)) / 1000 as m from lineitem group by all)
select l_orderkey, (case when m <= 1.5 then 1 when m <= 100.5 then 100 when m <= 1000.5 then 1000 when m <= 20000.5 then 10000 else 1 end)::bigint as scale from o""")
def value_scale(spark, sf_dir):
    m = F.col("m")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max(F.abs("l_extendedprice")) / 1000).alias("m"))
    return rows.select("l_orderkey", F.when(m <= 1.5, 1).when(m <= 100.5, 100).when(m <= 1000.5, 1000).when(m <= 20000.5, 10000).otherwise(1).cast("long").alias("scale"))


@query("""select l_orderkey, round(list_sort(list(l_extendedprice))[round_even((count(*) - 1) * 0.25, 0)::int + 1], 6) as q25 from lineitem group by all""")
def nearest_rank(spark, sf_dir):
    at = F.bround((F.count("*") - 1) * F.lit(0.25)).cast("int") + 1
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(r6(F.element_at(F.array_sort(F.collect_list("l_extendedprice")), at)).alias("q25"))


@query("""select p_partkey, lower(trim(p_name)) as header, regexp_extract(p_type, '([A-Z]+)$', 1) as tail, try_cast(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') as double) as number from part""")
def parse_labels(spark, sf_dir):
    number = F.try_to_number(F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")), F.lit("999999")).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("header"), F.regexp_extract("p_type", "([A-Z]+)$", 1).alias("tail"), number.alias("number"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_metadata(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"))


@query("""select doc_id, case when regexp_matches(text, '(?i)\\b(soil|sand|clay)\\b') then 'soil' when regexp_matches(text, '(?i)\\b(license|copyright)\\b') then 'license' when lang = 'en' then 'english' end as landcover from documents""")
def keyword_classify(spark, sf_dir):
    t = F.col("text")
    kind = F.when(t.rlike(r"(?i)\b(soil|sand|clay)\b"), "soil").when(t.rlike(r"(?i)\b(license|copyright)\b"), "license").when(F.col("lang") == "en", "english")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("landcover"))


@query("""select count(distinct o_custkey)::bigint as sources, count(*)::bigint as spectra, round(avg(o_totalprice), 6) as mean, round(quantile_cont(o_totalprice, 0.05), 6) as p05, round(quantile_cont(o_totalprice, 0.95), 6) as p95 from orders""")
def qa_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    q = quantiles(rows, [], "o_totalprice", [0.05, 0.95])
    one = rows.agg(F.countDistinct("o_custkey").alias("sources"), F.count("*").alias("spectra"), r6(F.avg("o_totalprice")).alias("mean"))
    return one.join(q, F.lit(True), "left").select("sources", "spectra", "mean", r6(F.col("q")[0]).alias("p05"), r6(F.col("q")[1]).alias("p95"))


@query("""with n as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, value from events)
select user_id, round(regr_slope(value, i), 6) as slope, round(abs(regr_slope(value, i) * count(*)), 5) as drift from n group by all having count(*) >= 3""")
def tail_drift(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("i", i).groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("s")).where("n >= 3")
    return rows.select("user_id", r6("s").alias("slope"), F.round(F.abs(F.col("s") * F.col("n")), 5).alias("drift"))


_HOURS = """with h as (select user_id, date_diff('hour', timestamp '1970-01-01', ts::timestamp) as h, avg(value) as v from events group by all),
g as (select *, lead(h) over (partition by user_id order by h) - h - 1 as gap from h)"""


@query(_HOURS + " select user_id, count(*)::bigint as points, coalesce(sum(gap), 0)::bigint as internal_missing, coalesce(max(gap), 0)::bigint as longest_gap from g group by all")
def gap_counters(spark, sf_dir):
    h = table(spark, sf_dir, "events").select("user_id", F.floor(F.expr("timestampdiff(second, timestamp_ntz'1970-01-01 00:00:00', ts)") / 3600).alias("h")).distinct()
    g = h.withColumn("gap", F.lead("h").over(Window.partitionBy("user_id").orderBy("h")) - F.col("h") - 1)
    return g.groupBy("user_id").agg(F.count("*").alias("points"), F.coalesce(F.sum("gap"), F.lit(0)).alias("internal_missing"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


@query("""with p as (select user_id, (epoch(ts::timestamp) / 3600)::double as x, value as v, event_id from events), d as (select user_id, x, v from p qualify row_number() over (partition by user_id, x order by event_id desc) = 1),
s as (select user_id, x as x0, v as v0, lead(x) over w as x1, lead(v) over w as v1 from d window w as (partition by user_id order by x))
select user_id, g::bigint as grid, round(v0 + (v1 - v0) * (g - x0) / (x1 - x0), 6) as value from (select *, unnest(range(ceil(x0 / 24)::bigint * 24, ceil(x1 / 24)::bigint * 24, 24)) as g from s where x1 is not null)""")
def grid_resample(spark, sf_dir):
    """Linear resampling of each user's series to a daily grid; of equal times the last value wins."""
    p = table(spark, sf_dir, "events").select("user_id", (F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts)") / 3.6e9).alias("x"), F.col("value").alias("v"), "event_id")
    d = p.groupBy("user_id", "x").agg(F.max_by("v", "event_id").alias("v"))
    w = Window.partitionBy("user_id").orderBy("x")
    s = d.withColumn("x1", F.lead("x").over(w)).withColumn("v1", F.lead("v").over(w)).where("x1 is not null")
    lo, hi = F.ceil(F.col("x") / 24) * 24, F.ceil(F.col("x1") / 24) * 24 - 24
    g = s.where(lo <= hi).withColumn("grid", F.explode(F.sequence(lo, hi, F.lit(24).cast("long"))))
    return g.select("user_id", "grid", r6(F.col("v") + (F.col("v1") - F.col("v")) * (F.col("grid") - F.col("x")) / (F.col("x1") - F.col("x"))).alias("value"))
