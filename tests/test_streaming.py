"""Streams of chunks against one batch, and long rows in any order."""

import pytest
from pyspark.sql import functions as F

from prismora.operators import estimators
from prismora.operators.knn import knn
from prismora.plans import catalogue
from prismora.streaming.mapping import chunk_rows, map_stream, samples, stream_samples

SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    library = table.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"))
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(None).cast("array<boolean>").alias("valid"))
    given, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    queries.repartition(3).write.parquet(given)

    def run():
        stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(given)
        map_stream(stream, library, out, check, 5).awaitTermination()
        return spark.read.parquet(out)

    def rows(frame):
        return sorted((r.query_id, r.pos, round(r.value, 9)) for r in frame.collect())

    want = rows(estimators.reconstruct(estimators.mean_weights(knn(queries, library, 5)), library))
    assert rows(run()) == want and len(want)
    assert run().select("chunk").distinct().count() > 1
    assert rows(run()) == want  # a second start finds nothing new
    more = [(1_000_000, [0.0] * 64, None)]
    spark.createDataFrame(more, queries.schema).write.mode("append").parquet(given)
    assert run().where("query_id = 1000000").count() == 64


def test_streamed_folder(spark, tmp_path):
    """The embeddings as a folder of files give what the one file gives."""
    spark.read.parquet(f"{SMALL}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    query = catalogue.queries()["streamed_mapping"]
    found, want = (sorted(map(tuple, query(spark, d).collect())) for d in (str(tmp_path), SMALL))
    assert found == want and len(want)


def test_samples(spark):
    given = [("a", "red", 0.1, None), ("b", "red", 0.3, False), ("a", "blue", 0.2, True), ("b", "blue", None, True), (None, "red", 0.5, True), ("a", "other", 9.0, True)]
    kind = "sample_id string, band_id string, reflectance double, valid boolean"
    rows = spark.createDataFrame(given, kind)
    found = {r.sample_id: (r.q, r.valid) for r in samples(rows, ["blue", "red"]).collect()}
    assert found == {"a": ([0.2, 0.1], [True, True]), "b": ([None, None], [False, False]), None: ([None, 0.5], [False, True])}
    assert samples(rows.limit(0), ["blue"]).count() == 0
    assert samples(rows.drop("valid"), ["red"]).where("sample_id = 'b'").first().q == [0.3]
    with pytest.raises(Exception, match="duplicate_band"):
        samples(rows.union(rows), ["red"]).collect()


def test_chunk_rows():
    assert chunk_rows(6, 2101) == (64 << 20) // (2107 * 8)
    assert chunk_rows(1 << 30, 1) == 1


def test_stream_samples(spark, tmp_path):
    """Samples that come interleaved over several batches are given out once, whole, as soon as they are."""
    kind = "sample_id string, band_id string, reflectance double"
    parts = [[("a", "b1", 0.1), ("b", "b2", 0.4), ("c", "b1", None), ("a", "zz", 9.0)], [("b", "b1", 0.3), ("c", "b2", 0.6), (None, "b1", 0.0)], [("a", "b2", 0.2), ("d", "b1", 0.7)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stream_samples(rows, ["b1", "b2"])
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {r.sample_id: (r.q, r.valid) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"a": ([0.1, 0.2], [True, True]), "b": ([0.3, 0.4], [True, True]), "c": ([None, 0.6], [False, True])}
