"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from prismora.operators.estimators import project_simplex, simplex_weights
from prismora.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, db, name):
    found = catalogue.queries()[name](spark, SMALL).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    want = db.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert plain(found, columns) == plain(want, columns)


def test_simplex_weights():
    rng = np.random.default_rng(0)
    x = rng.random((6, 9))
    true = np.array([0.5, 0.3, 0.2, 0, 0, 0])
    w = simplex_weights(x, true @ x)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and np.abs(w @ x - true @ x).max() < 1e-3
    assert simplex_weights(x, x[2]).tolist() == [0, 0, 1, 0, 0, 0]
    assert project_simplex(np.array([2.0, 0.0])).tolist() == [1, 0]
