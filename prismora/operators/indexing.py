"""Contiguous row numbers in the order of a scan, and other keys of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROWS_A_PARTITION = 1 << 33


def with_index(df: DataFrame, name: str = "row_index", start: int = 0) -> DataFrame:
    """df with numbers start, start + 1, ... in the order of its partitions and their rows; one count a partition is
    summed in one place, the rows stay where they are.

    df is evaluated twice, for the counts and for the rows, and must give the same partitions each time, as a scan does.
    What is dealt by sampled ranges need not.
    """
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.floor(F.col("_id") / _ROWS_A_PARTITION)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = marked.withColumn("_part", part).join(F.broadcast(counts.select("_part", "_base")), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_id") % _ROWS_A_PARTITION + F.lit(start)).drop("_id", "_part", "_base")


def row_id(source: str = "source_id", spectrum: str = "spectrum_id", sample: str = "sample_name"):
    return F.concat_ws(":", *[F.coalesce(F.col(c), F.lit("")) for c in (source, spectrum, sample)])
