"""op3's exchange between chunks and buckets: bounded tasks, no texts in a shuffle, results as by brute force."""

import numpy as np
import pyarrow as pa
import pytest
from brute import language_model
from pyspark.sql import functions as F

from prismora.llm import lm_score


@pytest.fixture
def small(monkeypatch):
    """Many chunks and buckets of few texts; the tables written on the way."""
    tables = {}
    write = lm_score.written
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(lm_score, "written", lambda df, tag, *more: tables.setdefault(tag, write(df, tag, *more)))
    return tables


def texts(n):
    return [(i, " ".join(f"w{(i * j * j + j) % 97}" for j in range(i % 60))) for i in range(n)]


def test_a_task_sums_one_bucket(spark, small):
    """By hash, a task could get several of the large buckets, and the more the larger the table."""
    lm_score.lm_score(spark.createDataFrame(texts(300), "doc_id long, text string"))
    by_file = small["counts"].where("chunk >= 0").groupBy(F.input_file_name()).agg(F.countDistinct("bucket").alias("b")).collect()
    assert len(by_file) > 4 and {r.b for r in by_file} == {1}
    assert "body" not in small["chunks"].columns  # texts stay in files; their names are exchanged


def test_many_chunks_and_buckets_give_the_same_scores(spark, small):
    rows = texts(200)
    found = lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(map(tuple, found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()))
    assert small["chunks"].count() > lm_score.CHUNKS
    want = language_model(rows, lm_score.ORDER, lm_score.MU)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in found], [x[5:] for x in want], rtol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_groups_run_over_batches(size):
    table = pa.table({"k": [1, 1, 1, 2, 3, 3, 3, 3, 5], "v": list(range(9))})
    found = [(t.column("k")[0].as_py(), t.column("v").to_pylist()) for t in lm_score._groups(iter(table.to_batches(size)), "k")]
    assert found == [(1, [0, 1, 2]), (2, [3]), (3, [4, 5, 6, 7]), (5, [8])]
