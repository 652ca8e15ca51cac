"""Repairs on planted faults, review metrics against plain loops, PCA fill, SQL functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismora import sql_functions
from prismora.functions import repairs as R
from prismora.functions.whittaker import smooth, solve
from prismora.operators import gapfill, repairs, review

X = np.arange(400, 2501).astype(float)
LINE = 0.2 + 0.1 * (X - 400) / 2100


def bump(a, b, by):
    y = LINE.copy()
    y[(X >= a) & (X <= b)] += by
    return y


def test_ramp():
    w = R.ramp(X, 500, 700, 50)
    at = lambda nm: w[int(nm - 400)]
    assert [at(n) for n in (449, 450, 500, 550, 600, 650, 700, 750, 751)] == pytest.approx([0, 0, 0.5, 1, 1, 1, 0.5, 0, 0])
    narrow = R.ramp(X, 500, 520, 50)  # the way down rules where both ramps meet
    assert narrow[70] == pytest.approx((470 - 450) / 100) and narrow[71] == pytest.approx((520 + 50 - 471) / 100)
    assert R.runs(np.array([0, 1, 1, 0, 1], bool)) == [(1, 2), (4, 4)] and R.step_up(X, 800, 50)[[349, 400, 451]].tolist() == [0, 0.5, 1]


@pytest.mark.parametrize(("rule", "span"), [(repairs.DEEP[0], (1330, 1455)), (repairs.DEEP[1], (1770, 1985)), (repairs.UNDERSTORY[0], (1355, 1435)), (repairs.UNDERSTORY[1], (1820, 2025))])
def test_windows_become_the_line(rule, span):
    fixed = R.bridged(bump(*span, 0.3), X, rule)
    inner = (X >= span[0] + 50) & (X <= span[1] - 50) if not rule.whole else (X >= span[0]) & (X <= span[1])
    assert fixed[inner] == pytest.approx(LINE[inner], abs=2e-3) and np.array_equal(fixed[X < span[0] - 70], LINE[X < span[0] - 70])
    assert R.bridged(LINE, X, rule) is None


def test_triggers():
    water = repairs.WATER[0]
    assert R.bridged(bump(1390, 1400, 0.2), X, water)[1395 - 400] == pytest.approx(LINE[1395 - 400], abs=1e-3)
    smooth_rise = LINE + 0.2 * np.exp(-(((X - 1402) / 20) ** 2))
    assert R.bridged(smooth_rise, X, water) is None  # high, but without a step
    falling = repairs.SHOULDER
    assert R.bridged(bump(1820, 1930, 0.1), X, falling) is None  # the left shoulder is the lower one
    down = LINE[::-1].copy()
    down[(X >= 1820) & (X <= 1930)] += 0.1
    assert R.bridged(down, X, falling)[1880 - 400] < down[1880 - 400]
    gone = bump(1330, 1455, 0.3)
    gone[(X >= 1280) & (X <= 1320)] = np.nan
    assert R.bridged(gone, X, repairs.DEEP[0]) is None


def test_spikes():
    y = LINE.copy()
    y[[1900 - 400, 1910 - 400]] += [0.3, 0.2]
    fixed = R.spikes(y, X, (1850, 1950), 3, 0.05)
    assert fixed == pytest.approx(LINE, abs=1e-6) and R.spikes(LINE, X, (1850, 1950), 3, 0.05) is None
    wide = bump(1395, 1398, 0.2)
    assert R.spikes(wide, X, (1368, 1425), 8, 0.08, 0.05, 120)[1396 - 400] == pytest.approx(LINE[1396 - 400], abs=1e-6)


def test_tails():
    drift = LINE.copy()
    drift[X > 2400] += np.linspace(0, 0.5, (X > 2400).sum())
    fixed = R.tail_line(drift, X, (2350, 2400), (2401, 2500), 50, 0.2)
    assert np.abs(fixed[X >= 2460] - LINE[X >= 2460]).max() < 1e-6 and R.tail_line(LINE, X, (2350, 2400), (2401, 2500), 50, 0.2) is None
    for f in (lambda y: R.tail_from_left(y, X), lambda y: R.constrained_tail(y, X), lambda y: R.tail_ramp(y, X, (2300, 2375), (2350, 2400), (2401, 2500), (-0.05, 1.2), 0.08, 0.08)):
        assert np.abs(f(drift)[X >= 2450] - LINE[X >= 2450]).max() < 0.02 and f(LINE) is None
    jumpy = LINE.copy()
    jumpy[X >= 2460] += 0.2
    assert np.abs(R.tail_extrapolated(jumpy, X, 2300, 2450, 8000.0, False)[X >= 2450] - LINE[X >= 2450]).max() < 0.01
    held = R.tail_extrapolated(jumpy, X, 2300, 2450, 8000.0, True)[X >= 2450]
    assert np.ptp(held) < 1e-12
    spiky = LINE.copy()
    spiky[2480 - 400] += 0.3
    assert np.abs(R.tail_smoothed(spiky, X, 2300, 2300, 1e4)[X >= 2350] - LINE[X >= 2350]).max() < 0.01 and R.tail_smoothed(LINE, X, 2300, 2300, 1e4) is None


def test_segments_and_bands():
    bad = bump(1400, 1405, 2.0)
    bad[0:3] = -1
    fixed = R.segments(bad, X)
    assert fixed == pytest.approx(LINE, abs=5e-3) and R.segments(LINE, X) is None
    assert R.segments(bad, X, low=1350)[0] == -1
    spiky = LINE + 1e-4 * np.random.default_rng(0).normal(size=2101)
    spiky[1000] += 0.4
    assert R.robust_bands(spiky, X)[1000] == pytest.approx(LINE[1000], abs=0.02)
    rough = LINE + np.where(np.arange(2101) % 2, 0.01, -0.01)
    done = R.smooth_above(rough, X)
    assert np.array_equal(done[X < 750], rough[X < 750]) and np.abs(np.diff(done[X > 900])).max() < 0.005
    splice = LINE.copy()
    splice[X >= 600] += 0.2
    assert np.abs(np.diff(R.visible_splice(splice, X, False))).max() < 0.05 and R.visible_splice(LINE, X, False) is None
    edge = LINE.copy()
    edge[X >= 700] += 0.2
    assert R.visible_splice(edge, X, True) is None and R.visible_splice(edge, X, False) is not None


def test_blue_edges():
    y = bump(430, 436, 0.2)
    assert R.edge_bridge(bump(431, 436, 0.2), X, 430, 436, 437) == pytest.approx(LINE, abs=1e-9) and R.edge_bridge(np.full(2101, np.nan), X, 430, 436, 437) is None and y[30] != LINE[30]
    gap = LINE.copy()
    gap[:40] = np.nan
    assert R.backfilled(gap, X) == pytest.approx(LINE, abs=1e-9) and R.backfilled(LINE, X) is None
    template = X / 1000
    made = R.stretched(bump(430, 499, 0.2), X, template, 420, 500, (430, 500))
    assert made[(X >= 420) & (X <= 500)] == pytest.approx(LINE[(X >= 420) & (X <= 500)], abs=0.01) and R.stretched(LINE, X, np.ones(2101), 420, 500, (430, 500)) is None


def test_guard_and_choice():
    rule = repairs.SMOOTH_WINDOWS["1400"]
    rng = np.random.default_rng(0)
    noisy = LINE + 0.02 * rng.normal(size=2101) * ((X > 1300) & (X < 1480))
    fixed = R.guarded(noisy, X, rule)
    assert R.kept_jump(fixed[(X > 1340) & (X < 1445)]) < R.kept_jump(noisy[(X > 1340) & (X < 1445)])
    assert R.best_of([noisy, fixed, noisy], X, rule) == 1 and R.best_of([LINE, LINE, noisy], X, rule) == 0 and R.window_score(LINE, X, rule)[2] < 1e-12


def test_outlier_windows():
    rng = np.random.default_rng(1)
    y = np.array([LINE + 0.0005 * rng.normal(size=2101) for _ in range(3)])
    y[1, 100] += 0.2
    fixed, counts = R.replace_flagged(y, X, repairs.OUTLIER_WINDOWS)
    assert counts.sum(axis=1).tolist() == [0, 1, 0] and fixed[1, 100] == pytest.approx(LINE[100], abs=0.01)
    mask, _ = R.flagged(y, X, repairs.OUTLIER_WINDOWS)
    blended, changed = R.blend_visible(y, X, mask)
    assert changed[0] == 0 and changed[1] > 50 and abs(blended[1, 100] - LINE[100]) < 0.12


def test_whittaker_equals_the_dense_system():
    rng = np.random.default_rng(0)
    for n in (3, 4, 7, 40):
        y, w, d = rng.normal(size=(2, n)), rng.random((2, n)) + 0.1, np.diff(np.eye(n), 2, axis=0)
        assert solve(w, y, 9.0) == pytest.approx(np.array([np.linalg.solve(np.diag(a) + 9 * d.T @ d, a * b) for a, b in zip(w, y)]))
    z, w = smooth(np.array([[np.nan, 1.0, np.nan, 2.0], [1.0, 2.0, 3.0, 4.0]]))
    assert np.isnan(z[0, 0]) and z[1] == pytest.approx([1, 2, 3, 4]) and w[0].tolist() == [0, 1, 0, 1]


def test_repairs_by_source(spark):
    rows = [("ghisacasia_v001", "a", "x", bump(1330, 1455, 0.3).tolist(), True), ("other", "b", "x", bump(1330, 1455, 0.3).tolist(), True), ("ghisacasia_v001", "c", "x", LINE.tolist(), True), ("ghisacasia_v001", "d", "x", bump(1330, 1455, 0.3).tolist(), False), ("ghisacasia_v001", "e", "x", None, True)]
    df = spark.createDataFrame(rows, "source_id string, spectrum_id string, landcover_group string, values array<double>, wanted boolean")
    done = repairs.repaired(df, repairs.DEEP_WINDOWS, only="wanted")
    notes = {r.spectrum_id: r.repairs for r in done.collect()}
    assert [len(notes[k]) for k in "abcde"] == [1, 0, 0, 0, 0] and notes["a"][0].name == "ghisacasia_deep_absorption_1400_interp" and notes["a"][0].max_abs_delta == pytest.approx(0.3, abs=0.01)
    told = repairs.report(done, "source_id", "spectrum_id")
    assert told.count() == 1 and repairs.by_source(told).first().repaired_spectra == 1
    v = spark.createDataFrame([("hyspiri_ground_targets", "a", LINE.tolist())], "source_id string, spectrum_id string, values array<double>")
    rough = v.withColumn("values", F.transform("values", lambda y, i: y + F.when(i % 2 == 0, 0.02).otherwise(0.0)))
    best = repairs.best_variants(rough, v, rough, ["source_id", "spectrum_id"]).first()
    assert {c.variant for c in best.choices} == {"old"} and len(best.choices) == 3 and best["values"][1400 - 400] == pytest.approx(LINE[1000])
    out = repairs.outlier_windows(v.withColumn("values", F.transform("values", lambda y, i: y + F.when(i == 100, 0.2).otherwise(0.0))))
    assert sum(out.first().flagged) >= 1 and repairs.outlier_windows(v, visible_only=True).first().flagged[-1] == 0
    t = repairs.templated(spark.createDataFrame([("ghisaconus_v001", "vegetation", bump(430, 499, 0.2).tolist())], "source_id string, landcover_group string, values array<double>"), X / 1000)
    assert t.first()["values"][60] == pytest.approx(LINE[60], abs=0.01)


def test_review(spark):
    rng = np.random.default_rng(3)
    y = np.array([LINE + 0.0005 * rng.normal(size=2101) for _ in range(30)])
    y[3, 150] += 0.4
    y[4, 1500] = 1.3
    y[5, 2001:] += np.linspace(0, 0.6, 100)
    y[6, :50] = np.nan
    m = review.measured(y, X)
    for k in range(30):
        f = np.isfinite(y[k])
        assert m["max_abs_jump"][k] == pytest.approx(np.nanmax(np.abs(np.diff(y[k])))) and m["valid_band_count"][k] == f.sum() and m["max_reflectance"][k] == np.nanmax(y[k]) and m["min_reflectance"][k] == np.nanmin(y[k])
        a, b = np.polyfit(X[1950:2001], y[k, 1950:2001], 1)
        assert m["tail_end_drift_2400"][k] == pytest.approx(np.abs(y[k, 2001:] - (a * X[2001:] + b)).max())
        assert m["max_interp_spike_absorption2"][k] == pytest.approx(max(abs(y[k, i] - (y[k, i - 3] + y[k, i + 3]) / 2) for i in range(1450, 1551)))
    df = spark.createDataFrame([("santa_barbara_urban_reflectance" if k == 5 else "s", str(k), r.tolist()) for k, r in enumerate(y)], "source_id string, spectrum_id string, values array<double>")
    scores = review.scored(review.metrics(df))
    bad = {r.spectrum_id for r in scores.where("is_suspicious").collect()}
    assert {"3", "4", "5"} <= bad and len(bad) <= 6
    assert {r.spectrum_id for r in review.strangest(scores, 3).collect()} == {"3", "4", "5"} and review.strangest_by(scores, 2).count() == 3
    assert scores.where(repairs.attempt()).count() == 1  # the one source that is always tried


def test_pca_fill(spark):
    rng = np.random.default_rng(5)
    base = np.stack([np.sin(X / 300), np.cos(X / 500), X / 2500])
    y = 0.4 + 0.05 * rng.random((40, 3)) @ base
    rows = [("soil" if k < 39 else None, "s", str(k), 2101.0, 400.0, 2500.0, v.tolist()) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "landcover_group string, source_id string, spectrum_id string, normalized_points double, native_min_nm double, native_max_nm double, values array<double>")
    full = gapfill.models(df, "landcover_group", (400, 2500), gapfill.DEEP_BANDS, gapfill.TRAIN_POINTS, gapfill.TRAIN_RANGE)
    blue = gapfill.models(df, "landcover_group", gapfill.BLUE_MODEL, gapfill.BLUE_BAND, gapfill.BLUE_POINTS, gapfill.BLUE_RANGE)
    assert set(full) == {"soil"} and full["soil"].components.shape[1] == 3 and full["soil"].rows >= 8
    gap = [[None if 1340 <= w <= 1360 or w < 430 else float(v) for w, v in zip(X, y[k])] for k in (0, 39)]
    given = spark.createDataFrame([("soil", gap[0]), (None, gap[1])], "landcover_group string, values array<double>")
    a, b = sorted(gapfill.filled(given, "landcover_group", full, blue).collect(), key=lambda r: r.landcover_group is None)
    assert np.abs(np.array(a["values"]) - y[0]).max() < 1e-3 and a.model_used == "soil_full+soil_blue" and a.gap_points == 21 + 30 and b["values"][0] is None and b.model_used == ""
    assert gapfill.band_noise(np.array([1.0, np.nan])) == float("inf") and gapfill.band_noise(np.ones(4)) == 0 and gapfill.fit(np.full((2, 3), np.nan), X[:3], {}) is None


def test_sql_functions(spark):
    names = sql_functions.register(spark)
    assert {"srf_average", "rms_distance", "confidence_score", "interp_grid", "whittaker", "simplex_weights"} <= set(names)
    one = lambda e: spark.sql(f"select {e}").first()[0]
    a = lambda *v: "array(" + ", ".join(f"{x}d" for x in v) + ")"
    assert one(f"srf_average({a(1, 2, 3)}, {a(0, 1, 1)})") == 2.5 and one(f"srf_average({a(1)}, {a(0)})") is None and one(f"rms_distance({a(0, 0)}, {a(3, 4)})") == pytest.approx(12.5**0.5)
    assert [one(f"blend_full(1d, 3d, {p}d, 800d, 1000d)") for p in (700, 800, 900, 1000, 1100)] == [1, 1, 2, 3, 3]
    assert one("confidence_score(1d, 0d, 0d, 1d, 0.5d)") == 1 and [one(f"confidence_band({s})") for s in ("0.85d", "0.6d", "0.1d", "cast(null as double)")] == ["high", "medium", "low", "unavailable"]
    assert [one(f"value_scale({a(v)}, cast({h} as double))") for v, h in ((1, "null"), (50, "null"), (500, "null"), (9000, "null"), (99999, "null"), (50, "7"))] == [1, 100, 1000, 10000, 1, 7]
    assert one(f"median_spacing({a(1, 2, 2, 5, 6)})") == 1 and one(f"median_spacing({a(1)})") is None and one(f"nearest_rank({a(3, 1, 2)}, 0.25d)") == 1
    for label, want in (("X400", 400), ("nm_2500", 2500), ("spc.350", 350), ("401.5 nm", 401.5), ("B2 at 865 of 20", 865), ("7", None), ("99999", None), ("\\'500\\'", 500)):
        assert one(f"wavelength_label('{label}')") == want, label
    assert one(f"interp_grid({a(1, 3)}, {a(10, 30)}, {a(0, 1, 2, 4)})") == [None, 10, 20, None] and one(f"fill_gaps_linear(array(1d, null, 3d))") == [1, 2, 3]
    assert one(f"simplex_weights(array({a(0, 0)}, {a(1, 1)}), {a(0.25, 0.25)})") == pytest.approx([0.75, 0.25], abs=1e-6) and len(one(f"whittaker({a(1, 2, 3, 4)}, 10d)")) == 4
