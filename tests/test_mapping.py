"""The mapper on the four-spectrum library, its files, its errors, and larger random libraries against plain numpy."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismora.cli import main
from prismora.errors import CodedError
from prismora.grid import CANONICAL, Grid
from prismora.mapping import benchmark, kernels, linear, retrieval
from prismora.mapping.mapper import Mapper
from prismora.mapping.prepare import build, build_once, opened, prepared, validate
from prismora.mapping.zarr import write_zarr
from prismora.operators import ann
from prismora.sources import archive, tables
from prismora.sources.sensors import Band, Sensor, gaussian, known_sensor, read_sensor_files, sensor_of

LEVELS = {"base": (0.15, 0.25, 0.25), "vnir_high": (0.80, 0.40, 0.20), "swir_high": (0.10, 0.90, 0.90), "mid": (0.60, 0.60, 0.60)}
W = CANONICAL.wavelengths
KIND = "row_index long, source_id string, spectrum_id string, sample_name string, values array<double>"


def steps(a, b, c):
    return np.select([W < 800, W <= 1000], [a, b], c).astype(float).tolist()


def definition(name, *bands):
    return {"sensor_id": name, "bands": [{"band_id": b, "response_definition": {"kind": "sampled", "wavelength_nm": [c - 5, c, c + 5], "response": [0.2, 1.0, 0.2]}, "extensions": {"any_name": {"segment": s}}} for b, s, c in bands]}


A = definition("sensor_a", ("blue", "vnir", 450), ("swir", "swir", 1600))
B = definition("sensor_b", ("target_vnir", "vnir", 500), ("target_swir", "swir", 1700))


@pytest.fixture(scope="module")
def mapper(spark):
    rows = [(k, "fixture_source", n, n, steps(*v)) for k, (n, v) in enumerate(LEVELS.items())]
    return Mapper(prepared(spark.createDataFrame(rows, KIND), [sensor_of(A), sensor_of(B)]))


def one(m, values, **options):
    return m.map_one(values, "sensor_a", **options)


def test_four_spectra(mapper):
    r = one(mapper, {"blue": 0.80, "swir": 0.20}, target="sensor_b", k=1)
    assert r["reflectance"] == pytest.approx([0.8, 0.2]) and r["source_fit_rmse"] == pytest.approx(0) and r["confidence"] == pytest.approx(1) and r["policy"] == "accept"
    r = one(mapper, {"blue": 0.80, "swir": 0.90}, target="sensor_b", k=1)
    assert r["reflectance"] == pytest.approx([0.8, 0.9])  # segments have their own neighbours
    full = one(mapper, {"blue": 0.80, "swir": 0.90}, mode="full_spectrum", k=1)["reflectance"]
    assert len(full) == 2101 and full[399] == pytest.approx(0.8) and full[400] == pytest.approx(0.4) and full[500] == pytest.approx(0.65) and full[600] == pytest.approx(0.9) and full[-1] == pytest.approx(0.9)
    assert len(one(mapper, [0.8, None], mode="vnir_spectrum", k=1)["reflectance"]) == 601 and len(one(mapper, [None, 0.2], mode="swir_spectrum", k=1)["reflectance"]) == 1701
    r = one(mapper, [0.8, float("nan")], target="sensor_b", k=1)
    assert r["reflectance"][0] == pytest.approx(0.8) and r["reflectance"][1] is None and r["swir"]["reason"] == "insufficient_valid_bands"
    r = one(mapper, {"blue": 0.8, "swir": 0.2}, valid={"swir": False}, target="sensor_b", k=2)
    assert r["reflectance"][0] == pytest.approx(0.7) and r["vnir"]["rows"] == [1, 3] and r["vnir"]["distances"] == pytest.approx([0, 0.2])


def test_requests_that_fail(mapper, spark):
    for options, part in (({"target": "sensor_b", "k": 0}, "k must"), ({"target": "sensor_c"}, "not in the prepared"), ({"mode": "target_sensor"}, "needs a target"), ({"mode": "x", "target": "sensor_b"}, "unknown output"), ({"target": "sensor_b", "estimator": "x"}, "unknown estimator"), ({"target": "sensor_b", "backend": "x"}, "unknown backend"), ({"target": "sensor_b", "eps": -1}, "eps")):
        with pytest.raises(CodedError, match=part) as e:
            one(mapper, [0.8, 0.2], **options)
        assert e.value.code == "invalid_mapping_input"
    with pytest.raises(CodedError, match="both segments"):
        one(mapper, [0.8, None], mode="full_spectrum")
    with pytest.raises(CodedError, match="one valid band"):
        one(mapper, [None, None], target="sensor_b")
    with pytest.raises(CodedError, match="one element a band"):
        one(mapper, [1.0], target="sensor_b")
    with pytest.raises(CodedError, match="exclude_row_id must"):
        one(mapper, [0.8, 0.2], target="sensor_b", exclude_row_id="nobody")
    batch = spark.createDataFrame([(0, "a", [0.8, 0.2]), (1, "b", [None, None]), (2, "c", [None, None])], "sample_index long, sample_id string, values array<double>")
    found = mapper.map_batch(batch, "sensor_a", target="sensor_b")
    assert found.where("error is null").count() == 1
    with pytest.raises(CodedError) as e:
        mapper.checked(found)
    assert e.value.context == {"sample_index": 1, "sample_id": "b"}
    for given, part in (({"include": [0, 9]}, "rows of the library"), ({"include": []}, "one at least"), ({"exclude_row_ids": ["x"]}, "row_id values"), ({"exclude_sample_names": ["x"]}, "sample_name values"), ({"exclude_sample_names": list(LEVELS)}, "no row")):
        with pytest.raises(CodedError, match=part):
            mapper.candidate_rows(**given)


def test_exclusions(mapper, spark):
    assert mapper.has_sample_name(" mid ") and not mapper.has_sample_name("x")
    some = mapper.candidate_rows([0, 1, 1, 3], ["fixture_source:base:base"])
    assert sorted(r[0] for r in some.collect()) == [1, 3]
    batch = spark.createDataFrame([(0, "vnir_high", [0.8, 0.2], None), (1, "x", [0.8, 0.2], "fixture_source:vnir_high:vnir_high"), (2, "y", [0.8, 0.2], None)], "sample_index long, sample_id string, values array<double>, exclude_row_id string")
    rows = {r.sample_id: r.reflectance for r in mapper.map_batch(batch, "sensor_a", target="sensor_b", k=1, self_exclude=True).collect()}
    assert rows["vnir_high"] == rows["x"] == pytest.approx([0.6, 0.25]) and rows["y"] == pytest.approx([0.8, 0.2])
    none = mapper.map_batch(batch, "sensor_a", target="sensor_b", k=1, candidates=mapper.candidate_rows([1]), self_exclude=True)
    assert {r.sample_id: r.error is None for r in none.collect()} == {"vnir_high": False, "x": False, "y": True}


def test_estimators_and_short_lists():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    q, valid = np.array([[0.25, 0.5], [1.0, 0.0]]), np.ones((2, 2), bool)
    at, far = kernels.nearest(q, valid, x, np.arange(4), 6)
    assert (at[:, 4:] == -1).all() and np.isinf(far[:, 4:]).all()
    near = np.where(at[:, :, None] >= 0, x[np.maximum(at, 0)], 0)
    for e in kernels.ESTIMATORS:
        w = kernels.weights(e, near, far, q, valid)
        assert w.sum(axis=1) == pytest.approx([1, 1]) and (w >= 0).all() and (w[:, 4:] == 0).all()
    w = kernels.weights("simplex_mixture", near, far, q, valid)
    assert np.einsum("nk,nkb->nb", w, near)[0] == pytest.approx([0.25, 0.5], abs=1e-6) and w[1, 0] == 1  # an exact hit takes all
    assert kernels.weights("distance_weighted_mean", near, far, q, valid)[1].tolist() == [1, 0, 0, 0, 0, 0]


def test_random_library_in_every_way(spark):
    """Broadcast, joined and blocked retrieval agree, and equal a plain search, with masks, ties and exclusions."""
    rng = np.random.default_rng(4)
    grid = Grid(0, 19, (0, 11), (8, 19), (8, 11))
    values = np.round(rng.random((60, 20)), 2)
    values[10] = values[20] = values[5]
    rows = spark.createDataFrame([(k, "s", str(k), f"n{k % 7}", v.tolist()) for k, v in enumerate(values)], KIND)
    band = lambda n, s, c: Band(n, s, (c - 1.0, float(c), c + 1.0), (0.5, 1.0, 0.5))
    m = Mapper(prepared(rows, [Sensor("x", (band("a", "vnir", 3), band("nir", "vnir", 6), band("c", "swir", 15))), Sensor("y", (band("p", "vnir", 9), band("q", "swir", 12)))], grid))
    feats = values @ m.sensor("x").weights(grid)
    goal = values @ m.sensor("y").weights(grid)
    given = [(k, f"n{k % 7}", (feats[k] * 1.1).tolist(), [k % 3 != 0, True, k % 4 != 0], f"s:{k}:n{k % 7}" if k % 2 else None) for k in range(30)]
    batch = spark.createDataFrame(given, "sample_index long, sample_id string, values array<double>, valid array<boolean>, exclude_row_id string")
    for estimator in ("simplex_mixture",):
        ways = [sorted(m.map_batch(batch, "x", target="y", k=4, min_valid_bands=2, estimator=estimator, self_exclude=True, ship_bytes=b).select("sample_index", "reflectance", "source_fit_rmse", "confidence").collect()) for b in (1 << 20, 1000, 10)]
        for other in ways[1:]:
            for r, s in zip(ways[0], other):
                assert [v is None for v in r.reflectance or []] == [v is None for v in s.reflectance or []]
                assert np.allclose(*[[v or 0 for v in t.reflectance or []] + [t.source_fit_rmse or 0, t.confidence or 0] for t in (r, s)], atol=1e-9)
    plain = {r.sample_index: r for r in m.map_batch(batch, "x", target="y", k=4, min_valid_bands=2, self_exclude=True).collect()}
    for k, _, q, ok, _ in given:
        allowed = [j for j in range(60) if j % 7 != k % 7]
        for out, places in ((0, [0, 1]), (1, [1, 2])):
            use = [p for p in places if ok[p]]
            got = plain[k].reflectance[out] if plain[k].reflectance else None
            if len(use) < 2:
                assert got is None
                continue
            order = sorted(allowed, key=lambda j: (round(float(np.sqrt(np.mean((np.array(q)[use] - feats[j][use]) ** 2))), 12), j))[:4]
            assert got == pytest.approx(goal[order, out].mean())
    full = [m.map_batch(batch, "x", "full_spectrum", k=3, ship_bytes=b).orderBy("sample_index").select("reflectance").collect() for b in (1 << 20, 1500, 10)]
    pick = lambda rows: [r.reflectance for r in rows if r.reflectance]
    assert len(pick(full[0])) and all(np.allclose(pick(full[0]), pick(f)) for f in full[1:])


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "lib").mkdir(), (tmp_path / "srf").mkdir()
    head = ",".join(f"nm_{w}" for w in W)
    cells = {n: ["" if v is None else repr(v) for v in steps(*lv)] for n, lv in LEVELS.items()}
    cells["mid"][0:2] = ["", ""]  # held at the edge
    cells["base"][100:103] = ["", "", ""]
    (tmp_path / "lib" / "m.csv").write_text("source_id,spectrum_id,sample_name,landcover_group\n" + "".join(f"fixture_source,{n},{n},soil\n" for n in LEVELS))
    (tmp_path / "lib" / "s.csv").write_text(f"source_id,spectrum_id,sample_name,{head}\n" + "".join(f"fixture_source,{n},{n},{','.join(c)}\n" for n, c in reversed(cells.items())))
    rows, gaps = tables.read_library(spark, f"{root}/lib/m.csv", f"{root}/lib/s.csv")
    assert gaps == {"interpolated_row_count": 2, "rows_with_leading_gaps": 1, "rows_with_trailing_gaps": 0, "rows_with_internal_gaps": 1, "max_missing_count": 3, "max_leading_gap_count": 2, "max_trailing_gap_count": 0, "max_internal_gap_count": 3, "max_internal_gap_run_count": 3}
    for d in (A, B):
        (tmp_path / "srf" / f"{d['sensor_id']}.json").write_text(json.dumps(d))
    sensors = read_sensor_files(spark, f"{root}/srf", ["sensor_a"])
    with pytest.raises(CodedError, match="could not be found"):
        read_sensor_files(spark, f"{root}/srf", ["nobody"])
    (tmp_path / "prepared").mkdir()  # is replaced
    p = build(spark, rows, sensors.values(), f"{root}/prepared", about={"x": 1})
    assert {r.row_index: (r.row_id, len(r.vnir), len(r.swir)) for r in p.library.collect()} == {k: (f"fixture_source:{n}:{n}", 601, 1701) for k, n in enumerate(LEVELS)}
    once = [build_once(spark, rows, sensors.values(), f"{root}/cache").library.count() for _ in range(2)]
    assert once == [4, 4] and len(list((tmp_path / "cache").iterdir())) == 1
    m = Mapper(f"{root}/prepared", spark, check=True)
    assert one(m, {"blue": 0.8, "swir": 0.2}, target="sensor_b", k=1)["reflectance"] == pytest.approx([0.8, 0.2], abs=1e-6)
    manifest = json.loads((tmp_path / "prepared" / "manifest.json").read_text())
    assert manifest["row_count"] == 4 and len(manifest["checksums"]) > 4
    # a batch by the command line, to files of both kinds
    (tmp_path / "q.csv").write_text("sample_id,exclude_row_id,blue,swir,valid_swir\nalpha,fixture_source:vnir_high:vnir_high,0.80,0.20,true\nbeta,fixture_source:swir_high:swir_high,0.80,0.90,false\n")
    common = ["--prepared-root", f"{root}/prepared", "--source-sensor", "sensor_a", "--target-sensor", "sensor_b", "--output-mode", "target_sensor", "--k", "1"]
    batch = ["map-reflectance-batch", *common, "--input", f"{root}/q.csv"]
    assert main([*batch, "--output", f"{root}/out.csv", "--neighbor-review-output", f"{root}/review", "--diagnostics-output", f"{root}/diag"], spark) == 0
    out = {r[0]: r[1:] for r in map(tuple, tables.read_manifest(spark, f"{root}/out.csv").collect())}
    assert [float(v) for v in out["alpha"]] == pytest.approx([0.6, 0.25], abs=1e-6) and out["beta"][1] == "" and float(out["beta"][0]) == pytest.approx(0.8, abs=1e-6)
    review = tables.read_manifest(spark, f"{root}/review").collect()
    assert sorted((r.sample_id, r.segment, r.neighbor_rank) for r in review) == [("alpha", "swir", "1"), ("alpha", "vnir", "1"), ("beta", "swir", ""), ("beta", "vnir", "1")]
    assert main([*batch, "--output", f"{root}/out.zarr", "--output-format", "zarr", "--output-chunk-size", "1"], spark) == 0
    z = tmp_path / "out.zarr"
    about = json.loads((z / "reflectance" / ".zarray").read_text())
    assert about["shape"] == [2, 2] and about["chunks"] == [1, 2]
    got = np.array([np.frombuffer((z / "reflectance" / f"{k}.0").read_bytes(), "<f8") for k in range(2)])
    assert got[0] == pytest.approx([0.6, 0.25], abs=1e-6) and np.isnan(got[1, 1])
    assert [np.frombuffer((z / "sample_id" / str(k)).read_bytes(), "<U64")[0] for k in range(2)] == ["alpha", "beta"]
    (tmp_path / "one.csv").write_text("band_id,reflectance\nblue,0.80\nswir,0.20\n")
    assert main(["map-reflectance", *common, "--input", f"{root}/one.csv", "--output", f"{root}/one"], spark) == 0
    assert [(r.band_id, r.segment) for r in tables.read_manifest(spark, f"{root}/one").collect()] == [("target_vnir", "vnir"), ("target_swir", "swir")]
    assert main(["validate-prepared-library", "--prepared-root", f"{root}/prepared"], spark) == 0
    assert main(["benchmark-mapping", "--prepared-root", f"{root}/prepared", "--source-sensor", "sensor_a", "--target-sensor", "sensor_b", "--k", "1", "--report", f"{root}/report.json"], spark) == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert {"target_sensor", "vnir_spectrum", "swir_spectrum", "full_spectrum"} <= set(report) and len(report["full_spectrum"]["retrieval"]["per_band_rmse"]) == 2101
    # an archive and its download
    digest = archive.pack(f"{root}/prepared", f"{root}/p.tar.gz")
    assert archive.download_library(spark, f"{root}/p.tar.gz", f"{root}/again") and (tmp_path / "p.tar.gz.sha256").read_text().startswith(digest)
    with pytest.raises(CodedError, match="SHA-256"):
        archive.download_library(spark, f"{root}/p.tar.gz", f"{root}/other", "0" * 64)
    # damage is found
    victim = next((tmp_path / "prepared" / "library").glob("*.parquet"))
    other = next((tmp_path / "prepared" / "features").rglob("*.parquet"))
    bad = dict(manifest, checksums=dict(manifest["checksums"], **{k: "0" for k in list(manifest["checksums"])[:1]}))
    with pytest.raises(CodedError, match="checksum"):
        validate(opened(spark, f"{root}/prepared"), bad)
    with pytest.raises(CodedError, match="numbered"):
        validate(opened(spark, f"{root}/prepared"), dict(manifest, row_count=5))
    assert victim.exists() and other.exists()
    (tmp_path / "prepared" / ".manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "prepared" / "manifest.json").write_text(json.dumps(dict(manifest, schema_version="9")))
    with pytest.raises(CodedError) as e:
        opened(spark, f"{root}/prepared")
    assert e.value.code == "prepared_library_incompatible"


def test_command_line_errors(spark, tmp_path, capsys):
    args = ["--json-errors", "map-reflectance", "--source-sensor", "a", "--input", "x", "--output", "y", "--output-mode", "vnir_spectrum"]
    assert main(args, spark) == 2
    assert json.loads(capsys.readouterr().err)["error_code"] == "invalid_cli_usage"
    assert main(["validate-prepared-library", "--prepared-root", f"file://{tmp_path}/none"], spark) == 2
    assert capsys.readouterr().err.startswith("missing_input_file: ")


def library_files(tmp_path, metadata, spectra):
    (tmp_path / "m.csv").write_text(metadata), (tmp_path / "s.csv").write_text(spectra)
    return f"file://{tmp_path}/m.csv", f"file://{tmp_path}/s.csv"


SMALL = Grid(400, 412, (400, 408), (404, 412), (404, 408))
HEAD = "source_id,spectrum_id,sample_name," + ",".join(f"nm_{w}" for w in SMALL.wavelengths) + "\n"


@pytest.mark.parametrize(("metadata", "spectra", "part"), [
    ("source_id,spectrum_id,sample_name\na,b,c\n", HEAD + "a,b,c" + ",1" * 12 + ",x\n", "numbers"), ("source_id,spectrum_id,sample_name\na,b,c\n", HEAD + ("a,b,c" + ",1" * 13 + "\n") * 2, "twice"),
    ("source_id,spectrum_id,sample_name\na,b,c\na,d,c\n", HEAD + "a,b,c" + ",1" * 13 + "\n", "without a spectrum"), ("source_id,spectrum_id,sample_name\na,b,c\n", HEAD + "a,b,c" + ",1" * 13 + "\n" + "a,d,c" + ",1" * 13 + "\n", "without metadata"),
    ("source_id,spectrum_id,sample_name\na,b,c\n", HEAD + "a,b,c" + ",1" + "," * 12 + "\n", "two values"), ("source_id,spectrum_id,sample_name\na,b,c\n", HEAD + "a,b,c,1" + "," * 10 + ",1,1\n", "too many gaps"),
    ("source_id,sample_name\na,c\n", HEAD, "identifier"), ("source_id,spectrum_id,sample_name\na,b,c\n", "source_id,spectrum_id,sample_name,nm_400\na,b,c,1\n", "on the grid"), ("source_id,spectrum_id,sample_name\n", HEAD, "empty"),
])
def test_faulty_libraries(spark, tmp_path, metadata, spectra, part):
    with pytest.raises(CodedError, match=part) as e:
        tables.read_library(spark, *library_files(tmp_path, metadata, spectra), SMALL)
    assert e.value.code == "prepare_failed"


def test_libraries_in_memory(spark):
    rows = [{"source_id": "s", "spectrum_id": str(k), "sample_name": "n", "values": [0.1 * k] * 13} for k in range(3)]
    rows[1]["values"] = {int(w): 0.5 for w in SMALL.wavelengths}
    assert [r["values"][0] for r in tables.in_memory(spark, rows, SMALL).orderBy("row_index").collect()] == [0, 0.5, 0.2]
    for bad in ([], [rows[0], rows[0]], [{**rows[0], "values": [1.0]}], [{**rows[0], "source_id": " "}]):
        with pytest.raises(CodedError):
            tables.in_memory(spark, bad, SMALL)


def test_sensors():
    s = sensor_of({"bands": [{"center_wavelength_nm": 650, "fwhm_nm": 30}, {"response_definition": {"wavelength_nm": [1500, 1510, 1490], "response": [1, 0.5, 0.5]}}], "band_id_policy": "deterministic"})
    assert s.band_ids == ["band_1", "band_2"] and [b.segment for b in s.bands] == ["vnir", "swir"] and s.sensor_id.startswith("custom_") and s.bands[1].wavelengths == (1490, 1500, 1510)
    assert sensor_of({"bands": [{"center_nm": 650, "fwhm_nm": 30}, {"response_definition": {"wavelength_nm": [1490, 1500, 1510], "response": [0.5, 1, 0.5]}}], "band_id_policy": "deterministic"}).sensor_id == s.sensor_id
    w, r = gaussian(650, 30)
    assert r[w.index(650)] == 1 and r[w.index(665)] == pytest.approx(0.5)
    weights = s.weights(CANONICAL)
    assert weights.sum(axis=0) == pytest.approx([1, 1]) and (weights[:, 1][W < 800] == 0).all()
    assert Sensor("x", (s.bands[0], Band("nir", "vnir", (850.0, 860.0, 870.0), (0.1, 1.0, 0.1)), s.bands[1])).searched("swir") == [1, 2]
    curves = {b: ((c - 10, c, c + 10), (0, 1, 0)) for b, c in {"B3": 469, "B4": 555, "B1": 645, "B2": 858, "B6": 1640, "B7": 2130}.items()}
    assert known_sensor("terra_modis", curves).band_ids == ["blue", "green", "red", "nir", "swir1", "swir2"]
    clip = sensor_of({"sensor_id": "c", "bands": [{"band_id": "edge", "segment": "vnir", "response_definition": {"wavelength_nm": [990, 1000, 1010], "response": [1, 1, 1]}}]})
    assert clip.bands[0].wavelengths == (990, 1000)
    good = {"band_id": "b", "segment": "vnir", "response_definition": {"wavelength_nm": [500, 510], "response": [1, 1]}}
    for bad in ([], [good, good], [{**good, "segment": "tir"}], [{**good, "response_definition": {"wavelength_nm": [500], "response": []}}], [{**good, "response_definition": {"wavelength_nm": [500, 500], "response": [1, 1]}}], [{**good, "response_definition": {"wavelength_nm": [500, 510], "response": [0, 0]}}], [{**good, "response_definition": {"wavelength_nm": [1500, 1510], "response": [1, 1]}}], [{"band_id": "b"}], [3]):
        with pytest.raises(CodedError) as e:
            sensor_of({"sensor_id": "s", "bands": bad})
        assert e.value.code == "invalid_sensor_schema"
    with pytest.raises(CodedError, match="policy"):
        sensor_of({"bands": [good], "segment_policy": "x"})
    with pytest.raises(CodedError, match="must be given"):
        sensor_of({"bands": [{k: v for k, v in good.items() if k != "segment"}], "segment_policy": "explicit"})


def test_linear_maps(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    y = x @ rng.random((4, 3)) + [1, 2, 3] + 0.01 * rng.random((300, 3))
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(5)
    fit = linear.fit(pairs)
    want = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert np.allclose(fit.bias, want[0]) and np.allclose(fit.weights, want[1:])
    rows = spark.createDataFrame([(0, x[0].tolist()), (1, None)], "k int, values array<double>")
    out = {r.k: r.reflectance for r in fit.apply(rows).collect()}
    assert out[0] == pytest.approx((x[0] @ want[1:] + want[0]).tolist()) and np.allclose(fit.map_array(x), x @ want[1:] + want[0]) and fit.map_array(x, "float32").dtype == np.float32
    same = spark.createDataFrame([([v, v], [2 * v]) for v in (0.0, 1.0, 2.0)], "x array<double>, y array<double>")
    assert linear.fit(same).map_array(np.array([[1.0, 1.0]]))[0, 0] == pytest.approx(2)  # rank one
    with pytest.raises(CodedError):
        linear.fit(pairs.limit(0))
    with pytest.raises(CodedError):
        fit.map_array(x[0])


def test_splits_and_benchmark(mapper, spark):
    assert [benchmark.held_out_rows(10, f, m) for f, m in ((0.21, None), (0.99, None), (0.5, 2), (0.01, None))] == [3, 9, 2, 1]
    want = np.random.default_rng(7).permutation(50)[:10].tolist()
    assert [r[0] for r in benchmark.permuted_split(spark, 50, 0.2, seed=7).collect()] == want
    for bad in ((1, 0.2, None), (9, 0.0, None), (9, 0.2, 0)):
        with pytest.raises(CodedError):
            benchmark.held_out_rows(*bad)
    test = spark.createDataFrame([(1,)], "row_index long")
    rows = {(r.block, r.method, r.band): r for r in benchmark.benchmark(mapper, "sensor_a", "sensor_b", k=1, test=test).collect()}
    # vnir_high is left out: blue 0.8 is nearest to mid's 0.6, swir 0.2 to base's 0.25
    assert rows["target_sensor", "retrieval", 0].rmse == pytest.approx(0.2) and rows["target_sensor", "retrieval", 1].bias == pytest.approx(0.05) and rows["target_sensor", "regression", 0].n == 1
    assert rows["vnir_spectrum", "retrieval", 0].mae == pytest.approx(0.2) and rows["full_spectrum", "retrieval", 2100].mae == pytest.approx(0.05) and len(rows) == 2 + 2 + 601 + 1701 + 2101


def test_map_arrays_and_linear(mapper):
    values, rmse = mapper.map_arrays(np.array([[0.8, 0.2], [0.1, np.nan]]), "sensor_a", target="sensor_b", k=1)
    assert values[0] == pytest.approx([0.8, 0.2]) and values[1, 0] == pytest.approx(0.1) and np.isnan(values[1, 1]) and rmse == pytest.approx([0, 0])
    fit = mapper.compile_linear("sensor_a", target="sensor_b")
    assert fit.map_array(np.array([[0.8, 0.2]]))[0] == pytest.approx([0.8, 0.2], abs=1e-6)
    assert len(mapper.compile_linear("sensor_a", "full_spectrum").bias) == 2101
    with mapper.__class__(mapper.library).cache() as m:
        assert m.has_sample_name("mid")


def test_zarr_refuses_gaps(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", [1.0], 0.1), (2, "b", [1.0], 0.1)], "sample_index long, sample_id string, reflectance array<double>, source_fit_rmse double")
    with pytest.raises(CodedError, match="numbered"):
        write_zarr(rows, f"file://{tmp_path}/z", "band_id", ["x"])
    assert write_zarr(rows.limit(0), f"file://{tmp_path}/z", "wavelength_nm", [400.0]) == 0 and not (tmp_path / "z" / "reflectance" / "0.0").exists()


def test_approximate_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    centers = rng.random((20, 8)) * 5
    x = centers[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 8))
    x[:1000] = x[0] + 1e-3 * rng.normal(size=(1000, 8))  # a third in one cell
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_id long, x array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[::60])], "query_id long, q array<double>")
    ann.save(ann.build(rows, 20), f"file://{tmp_path}/index")
    index = ann.load(spark, f"file://{tmp_path}/index")
    assert index.rows.count() == 3000  # every row is in a cell
    near = np.sqrt(((x[::60, None, :] - x[None]) ** 2).mean(axis=2))
    want = {(k, int(j)) for k, row in enumerate(near) for j in np.lexsort((np.arange(3000), row))[:5]}
    for backend in ann.BACKENDS:
        got = {(r.query_id, r.row_id) for r in ann.knn(queries, index, 5, ann.probes_for(backend, 20, 5, 0.1)).collect()}
        assert len(got & want) >= 0.9 * len(want), backend
    exact = {(r.query_id, r.row_id) for r in ann.knn(queries, index, 5, ann.probes_for("scipy_ckdtree", 20, 5)).collect()}
    assert exact == want and ann.build(rows.limit(0)).rows.count() == 0


def test_retrieval_of_nothing(spark):
    q = spark.createDataFrame([(0, [1.0], None, None, None)], "sample_index long, q array<double>, valid array<boolean>, exclude_row long, exclude_name long")
    lib = spark.createDataFrame([], "row_index long, name_code long, x array<double>")
    for ship in (1 << 20, -1):
        r = retrieval.retrieve(q, "f", lib, lib.select("row_index", F.col("x").alias("y")), [0], 3, ship_bytes=ship).first()
        assert not r.f.ok and r.f.reason == retrieval.EMPTY
    assert retrieval.retrieve(q.limit(0), "f", lib, None, [0], 3).count() == 0 and pa.__version__
