"""Exact quantiles of groups of any size: an approximate bracket, then an exact choice among the values inside it.

Spark's exact percentile keeps a group's distinct values in one task. Here percentile_approx gives a bracket of ranks
around each quantile, one pass counts the rows below it, and only the values inside are counted and summed in order:
about 0.4 % of the rows, and one row for any number of equal values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 2e-3  # of rank on both sides; twenty times the bracket's own error
MOST_GROUPS = 1_000_000
SMALL = 2000  # rows of a group that is its own bracket: the margin must be some ranks wide


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], F.lit(True))


def held(groups: DataFrame) -> DataFrame:
    """A row a group as a local table: computed once, and shipped by the joins that follow."""
    rows = groups.limit(MOST_GROUPS + 1).collect()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return groups.sparkSession.createDataFrame(rows, groups.schema)


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """by columns, n (values that are not null) and q: array of linearly interpolated quantiles, as numpy's default.

    Groups without a value are left out. The groups themselves are shipped to all tasks, so there must be at most MOST_GROUPS.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    cuts = [min(max(p + s * MARGIN, 0.0), 1.0) for p in probs for s in (-1, 1)]
    base = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, cuts)), ACCURACY).alias("_cuts"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    small = F.col("_n") <= SMALL
    least, most = F.col("_least"), F.col("_most")
    edge = [least if c == 0 else most if c == 1 else F.when(small, most if i % 2 else least).otherwise(F.col("_cuts")[i]) for i, c in enumerate(cuts)]
    named = held(base.select(*[F.col(n).alias(f"_{n}") for n in by], "_n", F.array(*edge[0::2]).alias("_lo"), F.array(*edge[1::2]).alias("_hi")))
    both = rows.join(F.broadcast(named), _same(by)).select(*by, "_v", "_n", "_lo", "_hi")
    # a value inside the bracket stands for itself, one below it for null: one count serves both
    places = F.filter(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.col("_v") <= F.get("_hi", i))
    near = both.select(*by, "_n", F.explode(F.transform(places, lambda i: F.struct(i.alias("_i"), F.when(F.col("_v") >= F.get("_lo", i), F.col("_v")).alias("_v")))).alias("_p"))
    counted = near.groupBy(*by, "_n", "_p._i", "_p._v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.sum("_c").over(upto))
    rank = F.get(F.array(*map(F.lit, probs)), F.col("_i")) * (F.col("_n") - 1)
    at = lambda r: F.min(F.when(F.col("_end") > r, F.col("_v")))
    one = placed.withColumn("_r", rank).groupBy(*by, "_i").agg(F.max("_n").alias("_n"), F.max("_r").alias("_r"), at(F.floor("_r")).alias("a"), at(F.ceil("_r")).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("_r") - F.floor("_r"))
    listed = one.groupBy(*by, "_n").agg(F.array_sort(F.collect_list(F.struct("_i", value_at.alias("q")))).alias("qs"))
    return listed.select(*by, F.col("_n").alias("n"), F.transform("qs", lambda s: s["q"]).alias("q"))


def median_and_mad(df: DataFrame, by: list[str], value: str, floor: float = 1e-9) -> DataFrame:
    """by columns, n, median, mad: 1.4826 times the median distance from the median, `floor` at least."""
    med = held(quantiles(df, by, value, [0.5]).select(*[F.col(n).alias(f"_{n}") for n in by], F.col("q")[0].alias("median")))
    off = df.select(*by, F.col(value).cast("double").alias("_x")).join(F.broadcast(med), _same(by)).select(*by, "median", F.abs(F.col("_x") - F.col("median")).alias("_off"))
    mad = quantiles(off.withColumn("_m", F.col("median")), [*by, "_m"], "_off", [0.5])
    return mad.select(*by, "n", F.col("_m").alias("median"), F.greatest(F.lit(1.4826) * F.col("q")[0], F.lit(floor)).alias("mad"))
