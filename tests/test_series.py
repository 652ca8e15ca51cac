"""Series kernels and statistics against direct numpy results."""

import numpy as np
import pytest

from prismora.functions import series as S
from prismora.operators import series, statistics

NAN = float("nan")


def test_fill_gaps():
    assert S.fill_gaps(np.array([NAN, 1, NAN, 3, NAN])).tolist() == [1, 1, 2, 3, 3]
    assert S.fill_gaps(np.array([1, NAN])) is None
    assert S.fill_gaps(np.array([1, *[NAN] * 9, 2])) is None


def test_spikes_and_tails():
    y = np.arange(20.0)
    y[10] = 50
    assert S.flatten_spikes(y, 5, 15, 2, 1.0)[10] == 10
    t = np.arange(20.0)
    t[15:] = 0
    assert S.extend_tail(t, 15, 10, 1.0) == pytest.approx(np.arange(20.0))
    assert S.extend_tail(np.arange(20.0), 15, 10, 1.0).tolist() == list(range(20))


def test_whittaker_finds_the_outlier():
    x = np.arange(60.0)
    y = np.sin(x / 12) + 0.01 * np.sin(7 * x)
    y[30] += 3
    z, w = S.whittaker(y, 10.0)
    assert w[30] == 0 and abs(z[30] - np.sin(2.5)) < 0.05
    fixed = S.replace_outliers(y, 0.5, strength=10.0)
    assert np.flatnonzero(fixed != y).tolist() == [30]
    line = 2 * x + 1
    assert S.whittaker(line)[0] == pytest.approx(line)


def test_mapped_keeps_nulls_and_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, None, 3.0], "a"), (2, None, None), (3, [], "c")], "id int, y array<double>, other string")
    found = {r.id: r for r in series.mapped(rows, "y", S.fill_gaps).collect()}
    assert found[1]["values"] == [1, 2, 3] and found[1].other == "a" and found[2]["values"] is None and found[3]["values"] is None


def test_principal_components(spark):
    x = np.random.default_rng(1).normal(size=(50, 4)) * [5, 3, 1, 0.1]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>").repartition(5)
    center, components = statistics.principal_components(rows, "x", 2)
    vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    assert center == pytest.approx(x.mean(axis=0)) and np.abs(np.sum(vt.T * components, axis=0)) == pytest.approx([1, 1])
    scores = {r.id: r.scores for r in statistics.project(rows, "x", center, components).collect()}
    assert scores[7] == pytest.approx(((x[7] - center) @ components).tolist())
