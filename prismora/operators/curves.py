"""Mean curves of groups of spectra from partial sums of whole arrays: pooled, by source, balanced, on common support."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import column, lists, matrix

HELD = 2000  # groups whose sums a task holds before it passes them on
SALTS = 32


def sums(df: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """by columns (strings), rows, sums and counts: arrays over the grid, null and NaN elements left out.

    A task adds up its rows in memory and passes one array a group on; those are added in two rounds, so that a group
    of any size ends in a few additions.
    """
    texts = [F.col(c).cast("string").alias(c) for c in by]
    schema = ", ".join(f"{c} string" for c in by) + ", rows long, sums array<double>, counts array<double>"

    def out(held: dict) -> pa.RecordBatch:
        keys = list(held)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(by))]
        n = pa.array([held[k][0] for k in keys], pa.int64())
        parts = [lists(np.stack([held[k][j] for k in keys]), blank=False) for j in (1, 2)]
        return pa.RecordBatch.from_arrays([*cols, n, *parts], names=[*by, "rows", "sums", "counts"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                v = matrix(column(b, values))
                ok = np.isfinite(v)
                keys = list(zip(*[column(b, c).to_pylist() for c in by])) if by else [()] * len(v)
                first: dict[tuple, list[int]] = {}
                for i, k in enumerate(keys):
                    first.setdefault(k, []).append(i)
                for k, at in first.items():
                    s, c = np.where(ok[at], v[at], 0.0).sum(axis=0), ok[at].sum(axis=0).astype(float)
                    if k in held:
                        held[k][0] += len(at)
                        held[k][1] += s
                        held[k][2] += c
                    else:
                        held[k] = [len(at), s, c]
                if len(held) >= HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    def added(d: pa.Table) -> pa.Table:
        n = pa.array([sum(d.column("rows").to_pylist())], pa.int64())
        cols = [d.column(c).slice(0, 1).combine_chunks() for c in by]
        return pa.Table.from_arrays([*cols, n, *[lists(matrix(d.column(c)).sum(axis=0)[None], blank=False) for c in ("sums", "counts")]], names=[*by, "rows", "sums", "counts"])

    parts = df.select(*texts, values).mapInArrow(partial, schema)
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.groupBy(*by, "_salt").applyInArrow(lambda d: added(d.drop_columns(["_salt"])), schema)
    return once.groupBy(*by).applyInArrow(added, schema)


def long(table: DataFrame, *by: str) -> DataFrame:
    """Sums by position: by columns, rows, pos, s, n (values), m (mean, null without a value)."""
    flat = table.select(*by, "rows", F.posexplode(F.arrays_zip("sums", "counts")).alias("pos", "p"))
    s, n = F.col("p.sums"), F.col("p.counts")
    return flat.select(*by, "rows", F.col("pos").cast("long").alias("pos"), s.alias("s"), n.cast("long").alias("n"), F.when(n > 0, s / n).alias("m"))


def pooled(points: DataFrame, group: str) -> DataFrame:
    """group, pos, mean over all spectra, n, sources with a value. points: long() by group and source."""
    n = F.sum("n")
    return points.groupBy(group, "pos").agg(F.when(n > 0, F.sum("s") / n).alias("mean"), n.alias("n"), F.count("m").alias("sources"))


def balanced(points: DataFrame, group: str) -> DataFrame:
    """group, pos, mean over sources of their means, sources."""
    return points.groupBy(group, "pos").agg(F.avg("m").alias("mean"), F.count("m").alias("sources"))


def common(points: DataFrame, group: str, source: str) -> DataFrame:
    """Balanced curves of the sources that have a value at every position."""
    whole = points.groupBy(group, source).agg(F.min("n").alias("least")).where("least > 0").select(group, source)
    return balanced(points.join(whole, [group, source]), group)


def jumps(curve: DataFrame, group: str, top: int) -> DataFrame:
    """The `top` largest steps between neighbouring positions of each group's mean: rank, pos (left), means, jump, n of both."""
    w = Window.partitionBy(group).orderBy("pos")
    steps = curve.select(group, "pos", F.col("mean").alias("left_mean"), F.lead("mean").over(w).alias("right_mean"), F.col("n").alias("left_n"), F.lead("n").over(w).alias("right_n"))
    steps = steps.withColumn("jump", F.col("right_mean") - F.col("left_mean")).where("jump is not null")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.abs("jump").desc(), "pos"))
    return steps.withColumn("jump_rank", rank.cast("long")).where(F.col("jump_rank") <= top)


def contributions(points: DataFrame, found: DataFrame, group: str, source: str, top: int) -> DataFrame:
    """What each source adds to a jump of the pooled mean, the `top` largest of each jump.

    With a source's share w of the values and its mean m left and right of the step: net = wR mR - wL mL,
    composition = (wR - wL) mR, within = wL (mR - mL). A mean that is missing counts as 0 in the net.
    """
    at = found.select(group, "jump_rank", F.col("pos").alias("left_pos"), "left_n", "right_n")
    left = points.select(group, source, F.col("pos").alias("left_pos"), F.col("n").alias("ln"), F.col("m").alias("lm"))
    right = points.select(group, source, (F.col("pos") - 1).alias("left_pos"), F.col("n").alias("rn"), F.col("m").alias("rm"))
    both = at.join(left, [group, "left_pos"]).join(right, [group, "left_pos", source])
    wl, wr = F.col("ln") / F.col("left_n"), F.col("rn") / F.col("right_n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = both.select(
        group, "jump_rank", "left_pos", source, F.col("ln").alias("left_support"), F.col("rn").alias("right_support"), wl.alias("left_weight"), wr.alias("right_weight"), F.col("lm").alias("left_mean"), F.col("rm").alias("right_mean"),
        (zero(wr * F.col("rm")) - zero(wl * F.col("lm"))).alias("net"), ((wr - wl) * F.col("rm")).alias("composition"), (wl * (F.col("rm") - F.col("lm"))).alias("within"),
    )
    rank = F.row_number().over(Window.partitionBy(group, "jump_rank").orderBy(F.abs("net").desc(), source))
    return rows.withColumn("contributor_rank", rank.cast("long")).where(F.col("contributor_rank") <= top)
