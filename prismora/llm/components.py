"""Connected components of an edge table by alternating large-star and small-star.

Each half round is a minimum per node (combined before the shuffle) joined back to the edges, so no node's
neighbours are ever collected; hot nodes are a skewed join that AQE splits. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Does every node hang on one smaller node, which hangs on none? Then each component is one star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("end")).select("end.*")
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node. edges: columns a, b.

    Nulls, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    down = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(down.distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        after = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(now)
        now = after
    raise RuntimeError("components did not settle")
