"""Exact k-nearest-neighbour join by root-mean-square distance over valid bands: (query_id, rank, row_id, distance).

The search is the mapping's (see mapping/retrieval.py): the library is shipped to the tasks while it fits a bound that
is checked, beyond it blocks of queries meet blocks of the library. Nothing of the queries passes the driver.
Order: distance, then row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..mapping import retrieval


def knn(queries: DataFrame, library: DataFrame, k: int, exclude_own: bool = False, ship_bytes: int = retrieval.SHIP_BYTES) -> DataFrame:
    """queries: query_id, q, valid (array of boolean, or null: all); library: row_id, x.

    exclude_own: the library row whose id is the query's is left out. Fewer than k rows give fewer neighbours; a query
    without a valid band has none.
    """
    none = F.lit(None).cast("long")
    given = queries.select(F.col("query_id").alias("sample_index"), F.col("q").cast("array<double>").alias("q"), "valid", (F.col("query_id") if exclude_own else none).alias("exclude_row"), none.alias("exclude_name"))
    features = library.select(F.col("row_id").alias("row_index"), none.alias("name_code"), F.col("x").cast("array<double>").alias("x"))
    width = library.select(F.size("x")).first()
    places = list(range(width[0])) if width else []
    found = retrieval.retrieve(given, "found", features, None, places, k, ship_bytes=ship_bytes, rows=library.count())
    near = F.arrays_zip(F.col("found.rows").alias("row_id"), F.col("found.distances").alias("distance"))
    rows = found.where("found.ok").select(F.col("sample_index").alias("query_id"), F.posexplode(near).alias("at", "n"))
    return rows.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("n.row_id").alias("row_id"), F.col("n.distance").alias("distance"))
