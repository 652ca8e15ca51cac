"""Tables behind the maintainers' reports: repair stages, means before and after, boundary steps, samples, strange spectra."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves
from ..operators.curation import sampled
from ..operators.quantiles import quantiles
from .package import URBAN, URBAN_END

KEY = ["source_id", "spectrum_id"]


def stage_report(metadata: DataFrame, stages: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """by_source (stage, source, affected and all spectra, share), by_stage, and overall: the spectra of any stage.

    stages: rows with source_id and spectrum_id, in any number a spectrum.
    """
    totals = metadata.groupBy("source_id").agg(F.countDistinct("spectrum_id").alias("total_spectra"))
    all_rows = totals.agg(F.sum("total_spectra").alias("n"))
    pairs = {k: df.select(*KEY).distinct() for k, df in stages.items()}

    def against(affected: DataFrame) -> DataFrame:
        out = affected.join(totals, "source_id", "left").withColumn("total_spectra", F.coalesce("total_spectra", F.lit(0)))
        return out.withColumn("affected_pct", F.try_divide("affected_spectra", "total_spectra"))

    named = reduce(DataFrame.unionByName, [df.withColumn("stage", F.lit(k)) for k, df in pairs.items()])
    by_source = against(named.groupBy("stage", "source_id").agg(F.countDistinct("spectrum_id").alias("affected_spectra")))
    by_stage = named.groupBy("stage").agg(F.countDistinct("spectrum_id").alias("affected_spectra"), F.countDistinct("source_id").alias("affected_source_count")).join(F.broadcast(all_rows), F.lit(True))
    by_stage = by_stage.withColumn("affected_pct_of_dataset", F.try_divide("affected_spectra", "n")).drop("n")
    overall = against(named.select(*KEY).distinct().groupBy("source_id").agg(F.countDistinct("spectrum_id").alias("affected_spectra")))
    return {"by_source": by_source, "by_stage": by_stage, "overall": overall}


def group_means(spectra: DataFrame, group: str = "landcover_group", values: str = "values") -> DataFrame:
    """group, pos, mean, n of every place."""
    points = curves.long(curves.sums(spectra.where(F.col(group).isNotNull()), [group], values), group)
    return points.select(group, "pos", F.col("m").alias("mean"), "n")


def before_after(before: DataFrame, after: DataFrame, group: str = "landcover_group") -> DataFrame:
    """group, pos, means of both datasets and their difference."""
    a = group_means(before, group).select(group, "pos", F.col("mean").alias("before"))
    b = group_means(after, group).select(group, "pos", F.col("mean").alias("after"))
    return a.join(b, [group, "pos"], "full").withColumn("delta", F.col("after") - F.col("before"))


def changed_sample(flags: DataFrame, labels: DataFrame, spectra: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Spectra of `n` changed ones of each class: flags (flagged_band_count > 0) with labels, sampled by a seeded hash."""
    rows = flags.where("flagged_band_count > 0").join(labels.select(*KEY, "landcover_group"), KEY).where("landcover_group is not null")
    picked = sampled(rows, ["landcover_group"], n, KEY, seed)
    return spectra.join(F.broadcast(picked.select(*KEY, "landcover_group", "flagged_band_count")), KEY)


def boundary_means(spectra: DataFrame, place: int, group: str = "landcover_group", values: str = "values") -> DataFrame:
    """group, n, mean absolute step from place to place + 1 and mean absolute curvature at place, where all three values are there."""
    a, b, c = (F.get(values, F.lit(place + k)).cast("double") for k in (-1, 0, 1))
    step, bend = F.abs(c - b), F.abs(a - 2 * b + c)
    rows = spectra.select(group, step.alias("s"), bend.alias("k")).where("s is not null and k is not null and not isnan(s) and not isnan(k)")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("s").alias("mean_abs_jump"), F.avg("k").alias("mean_abs_curvature"))


def boundary_comparison(datasets: Mapping[str, DataFrame], place: int, group: str = "landcover_group") -> DataFrame:
    """boundary_means of several datasets side by side, a row a group."""
    parts = [boundary_means(df, place, group).select(group, F.col("n").alias(f"{k}_spectra"), F.col("mean_abs_jump").alias(f"{k}_mean_abs_jump"), F.col("mean_abs_curvature").alias(f"{k}_mean_abs_curvature")) for k, df in datasets.items()]
    return reduce(lambda a, b: a.join(b, group, "full"), parts)


def display_means(spectra: DataFrame, group: str = "landcover_group") -> DataFrame:
    """group_means of the spectra that stand for their class: urban ones only if they reach 2450 nm."""
    return group_means(spectra.where((F.col(group) != URBAN) | (F.col("native_max_nm") >= URBAN_END)), group)


def group_samples(rows: DataFrame, groups: Sequence[str], n: int, seed: int, keys: Sequence[str] = KEY, group: str = "landcover_group", step: int = 997) -> DataFrame:
    """`n` rows of each of the groups, the k-th with seed + step * k."""
    return reduce(DataFrame.unionByName, [sampled(rows.where(F.col(group) == g), [group], n, keys, seed + step * k) for k, g in enumerate(groups)])


def source_means(spectra: DataFrame, group_value: str, group: str = "landcover_group") -> DataFrame:
    """source_id, pos, mean, n of one class."""
    points = curves.long(curves.sums(spectra.where(F.col(group) == group_value), ["source_id"]), "source_id")
    return points.select("source_id", "pos", F.col("m").alias("mean"), "n")


def window_deltas(before: DataFrame, after: DataFrame, windows: Mapping[str, Iterable[tuple[str, int, int]]], start: int = 400) -> DataFrame:
    """source_id, window, mean and largest absolute change of the source's mean curve inside each of its windows."""
    sources = list(windows)
    a = curves.long(curves.sums(before.where(F.col("source_id").isin(sources)), ["source_id"]), "source_id").select("source_id", "pos", F.col("m").alias("a"))
    b = curves.long(curves.sums(after.where(F.col("source_id").isin(sources)), ["source_id"]), "source_id").select("source_id", "pos", F.col("m").alias("b"))
    spans = before.sparkSession.createDataFrame([(s, w, lo - start, hi - start) for s, ws in windows.items() for w, lo, hi in ws], "source_id string, window string, lo long, hi long")
    both = a.join(b, ["source_id", "pos"]).join(F.broadcast(spans), "source_id").where("pos between lo and hi")
    return both.groupBy("source_id", "window").agg(F.avg(F.abs(F.col("b") - F.col("a"))).alias("mean_abs_delta"), F.max(F.abs(F.col("b") - F.col("a"))).alias("max_abs_delta"))


def spectra_of(rows: DataFrame, spectra: DataFrame) -> DataFrame:
    """The spectra of a few reviewed rows, such as the strangest."""
    return spectra.join(F.broadcast(rows.select(*KEY).distinct()), KEY, "left_semi")


def quality_tables(metadata: DataFrame, summary: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """What the quality plots show: sources by spectra and by failure rate, histograms, range against points, and the metrics."""
    rate = F.try_divide("failure_count", F.col("failure_count") + F.col("normalized_spectra"))
    bins = lambda c, width: (F.floor(F.col(c).cast("double") / width) * width).alias(c)
    share = metadata.withColumn("coverage", F.col("normalized_points").cast("double") / 2101)
    q = quantiles(share, [], "coverage", [0.05, 0.95])
    one = share.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("spectra"), F.avg("coverage").alias("mean_coverage"))
    one = one.join(q.select(F.col("q")[0].alias("p05_coverage"), F.col("q")[1].alias("p95_coverage")), F.lit(True), "left")
    return {
        "largest_sources": summary.orderBy(F.desc("normalized_spectra"), "source_id").limit(top).select("source_id", "normalized_spectra"),
        "failure_rates": summary.withColumn("failure_rate", rate).orderBy(F.desc("failure_rate"), "source_id").limit(top).select("source_id", "failure_rate"),
        "parser_counts": metadata.groupBy("parser").agg(F.count("*").alias("n")),
        "coverage_histogram": share.groupBy(bins("coverage", 0.05)).agg(F.count("*").alias("n")),
        "spacing_histogram": metadata.groupBy(bins("native_spacing_nm", 0.5)).agg(F.count("*").alias("n")),
        "native_ranges": metadata.groupBy(bins("native_min_nm", 50), bins("native_max_nm", 50)).agg(F.count("*").alias("n")),
        "metrics": one,
    }


def pair_metrics(per_band: DataFrame, about: Mapping[str, str]) -> DataFrame:
    """One row of a sensor pair: bands, mean absolute error, root mean square error, samples. per_band: benchmark.metrics."""
    out = per_band.agg(F.count("*").alias("evaluated_band_count"), F.avg("mae").alias("mean_abs_error"), F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse"), F.max("n").alias("sample_count"))
    for k, v in about.items():
        out = out.withColumn(k, F.lit(v))
    return out
