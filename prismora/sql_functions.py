"""SQL functions: pure expressions as SQL functions, kernels as vectorised ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from .functions.series import fill_linear
from .functions.whittaker import smooth
from .mapping import kernels

DOUBLES = ArrayType(DoubleType())
SQL = {
    "srf_average": ("v array<double>, w array<double>", "double", "try_divide(aggregate(zip_with(v, w, (a, b) -> a * b), 0d, (s, x) -> s + x), aggregate(w, 0d, (s, x) -> s + x))"),
    "rms_distance": ("a array<double>, b array<double>", "double", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0d, (s, x) -> s + x) / size(a))"),
    "blend_full": ("x double, y double, place double, lo double, hi double", "double", "case when place < lo then x when place > hi then y else (hi - place) / (hi - lo) * x + (place - lo) / (hi - lo) * y end"),
    "confidence_score": (
        "coverage double, distance double, rmse double, top double, scale double", "double",
        "least(1d, greatest(0d, 0.25d * coverage + 0.35d * exp(-distance / if(scale <= 1e-12d, 1d, scale)) + 0.25d * exp(-rmse / if(scale <= 1e-12d, 1d, scale)) + 0.15d * top))",
    ),
    "confidence_band": ("score double", "string", "case when score is null then 'unavailable' when score >= 0.85d then 'high' when score >= 0.6d then 'medium' else 'low' end"),
    "value_scale": ("v array<double>, hint double", "double", "case when hint > 0 then hint when array_max(transform(v, x -> abs(x))) <= 1.5d then 1d when array_max(transform(v, x -> abs(x))) <= 100.5d then 100d when array_max(transform(v, x -> abs(x))) <= 1000.5d then 1000d when array_max(transform(v, x -> abs(x))) <= 20000.5d then 10000d else 1d end"),
    "median_spacing": (
        "w array<double>", "double",
        "aggregate(array(array_sort(filter(transform(sequence(1, greatest(size(w) - 1, 1)), i -> get(w, i) - get(w, i - 1)), x -> x > 0))), cast(null as double), (s, d) -> case when size(d) = 0 then null when size(d) % 2 = 1 then get(d, cast((size(d) - 1) / 2 as int)) else (get(d, cast(size(d) / 2 as int) - 1) + get(d, cast(size(d) / 2 as int))) / 2 end)",
    ),
    "nearest_rank": ("v array<double>, share double", "double", "get(array_sort(v), cast(least(greatest(bround((size(v) - 1) * share), 0), size(v) - 1) as int))"),
    "wavelength_label": (
        "label string", "double",
        "aggregate(array(trim(both '\"''' from trim(label))), cast(null as double), (z, s) -> get(filter(transform(concat(array(nullif(regexp_extract(s, '(?i)^(?:x|wl|nm_)?(\\\\d+(?:\\\\.\\\\d+)?)$', 1), ''), nullif(regexp_extract(s, '(?i)^spc\\\\.?(\\\\d+(?:\\\\.\\\\d+)?)$', 1), ''), nullif(regexp_extract(s, '(?i)^(\\\\d+(?:\\\\.\\\\d+)?)\\\\s*(?:nm|nanometers?)?$', 1), '')), reverse(regexp_extract_all(s, '(?<!\\\\d)(\\\\d{3,4}(?:\\\\.\\\\d+)?)(?!\\\\d)', 1))), t -> cast(t as double)), w -> w between 100 and 3000), 0))",
    ),
}


@pandas_udf(DOUBLES)
def interp_grid(w: pd.Series, v: pd.Series, grid: pd.Series) -> pd.Series:
    """Linear on the grid, null outside the range of w, which must increase."""

    def one(a, b, g):
        if a is None or b is None or g is None or len(a) < 1:
            return None
        y = np.interp(g, a, b)
        return [None if x < a[0] or x > a[-1] else float(z) for x, z in zip(g, y)]

    return pd.Series([one(*r) for r in zip(w, v, grid)])


@pandas_udf(DOUBLES)
def whittaker(v: pd.Series, strength: pd.Series) -> pd.Series:
    """Robust smooth of each series."""
    return pd.Series([None if y is None else smooth(np.array(y, float)[None], float(s))[0][0].tolist() for y, s in zip(v, strength)])


@pandas_udf(DOUBLES)
def fill_gaps_linear(v: pd.Series) -> pd.Series:
    return pd.Series([None if y is None else fill_linear(np.array(y, float)).tolist() for y in v])


@pandas_udf(DOUBLES)
def simplex_weights(near: pd.Series, q: pd.Series) -> pd.Series:
    """Mixture weights of neighbours (array of arrays) for a query."""

    def one(x, y):
        x, y = np.array([list(r) for r in x], float), np.array(y, float)
        far = np.sqrt(((x - y) ** 2).mean(axis=1))[None]
        return kernels.weights("simplex_mixture", x[None], far, y[None], np.ones((1, len(y)), bool))[0].tolist()

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(near, q)])


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, as temporary ones; their names."""
    for name, (args, kind, body) in SQL.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    made = {"interp_grid": interp_grid, "whittaker": whittaker, "fill_gaps_linear": fill_gaps_linear, "simplex_weights": simplex_weights}
    for name, f in made.items():
        spark.udf.register(name, f)
    return [*SQL, *made]
