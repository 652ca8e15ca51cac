"""Text spectra of every layout, in archives too."""

import zipfile

import pytest

from prismora.errors import CodedError
from prismora.sources import normalize as N
from prismora.sources import tables
from prismora.sources import text_spectra as T

KEYED = "Name: Granite\nX Units: Wavelength (micrometers)\nY Units: Reflectance (percent)\n\n0.4 10\n0.5 20\n"
ROWS = "# made by hand\nsample_id,site,400,401 nm,X402\na,s1,0.1,0.2,0.3\nb,s2,NA,\"0.5\",0.6\n"
COLUMNS = "Wavelength;soil;water\n400;0,1;0,9\n401;0,2;0,8\n"
LONG = "sample_name\twl\treflectance\nu\t400\t1\nu\t410\t2\nv\t400\t3\nv\t410\t4\nu\t400\t5\nu\t410\t6\n"


def test_labels_and_numbers():
    assert [T.wavelength(s) for s in ("X400", "nm_2500", "spc.350", "401.5 nm", "B2 at 865 of 20", "7", "99999")] == [400, 2500, 350, 401.5, 865, None, None]
    assert [T.number(s) for s in ("1,5", "12 %", "N/A", "x", "1.5")] == [1.5, 12, None, None, 1.5]


def test_layouts():
    (s,) = T.parsed(KEYED.encode(), "d/k.txt")
    assert (s.sample_name, s.values, s.value_scale_hint) == ("Granite", [10, 20], 100) and s.wavelengths_nm == pytest.approx([400, 500])
    a, b = T.parsed(ROWS.encode(), "r.csv")
    assert (a.sample_name, a.values, a.metadata["site"]) == ("a", [0.1, 0.2, 0.3], "s1") and b.wavelengths_nm == [401, 402]
    assert [(s.sample_name, s.values) for s in T.parsed(COLUMNS.encode("latin-1"), "c.csv")] == [("soil", [0.1, 0.2]), ("water", [0.9, 0.8])]
    assert [(s.sample_name, s.values) for s in T.parsed(LONG.encode(), "l.tab")] == [("u", [1, 2]), ("v", [3, 4]), ("u", [5, 6])]
    assert T.parsed(b"", "e.txt") == [] and [s.parser for s in T.parsed(b"400 1\n401 2\n402 3\n", "p.txt")] == ["text_pairs"]


def test_two_row_headers():
    (s,) = T.parsed(b"index,spectra,,,\nlambda,350,351,352\nA001,0.1,0.2,0.3\n", "two_row.csv")  # the reference's example
    assert (s.parser, s.sample_name, s.wavelengths_nm, s.values) == ("csv_row_wide", "A001", [350, 351, 352], [0.1, 0.2, 0.3])
    a, b = T.parsed(b"index,spectra,,,\nlambda,350,351,352\n1001,0.1,0.2,0.3\n1002,0.4,,0.6\n", "numbers.csv")
    assert (a.sample_name, a.values) == ("1001", [0.1, 0.2, 0.3]) and (b.sample_name, b.wavelengths_nm, b.values) == ("1002", [350, 352], [0.4, 0.6])


def test_read_and_resample(spark, tmp_path):
    (tmp_path / "k.txt").write_text(KEYED)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/c.csv", COLUMNS)
    rows = N.read_spectra(spark, str(tmp_path))
    found = {(r.input_path.rsplit("/", 1)[-1], r.sample_name): r for r in rows.collect()}
    assert set(found) == {("k.txt", "Granite"), ("bad.zip", None), ("c.csv", "soil"), ("c.csv", "water")}
    assert "::in/" in found["c.csv", "soil"].input_path and found["bad.zip", None].reason
    grid = {r.sample_name: r for r in N.on_grid(rows).collect()}
    assert grid["soil"].normalized_points == 2 and grid["soil"]["values"][:3] == [0.1, 0.2, None]
    assert grid["Granite"]["values"][50] == pytest.approx(0.15) and len(grid["Granite"]["values"]) == 2101


def test_queries_long_equal_wide(spark, tmp_path):
    (tmp_path / "w.csv").write_text("sample_id,exclude_row_id,blue,swir,valid_swir\nalpha,s:a:a,0.8,0.2,true\nbeta,,0.8,0.9,false\n")
    (tmp_path / "l.csv").write_text("sample_id,band_id,reflectance,valid,exclude_row_id\nalpha,blue,0.8,,s:a:a\nbeta,blue,0.8,,\nalpha,swir,0.2,yes,s:a:a\nbeta,swir,0.9,0,\n")
    wide, long = (sorted(map(tuple, tables.read_queries(spark, str(tmp_path / f), ["blue", "swir"]).collect())) for f in ("w.csv", "l.csv"))
    assert wide == long == [("alpha", "s:a:a", [0.8, 0.2], [True, True]), ("beta", None, [0.8, 0.9], [True, False])]
    rows = spark.createDataFrame([("a", [1.0, float("nan")])], "sample_id string, values array<double>")
    tables.write_results(rows, str(tmp_path / "out"), ["x", "y"])
    assert [tuple(r) for r in tables.read_manifest(spark, str(tmp_path / "out")).collect()] == [("a", "1.0", "")]


def test_sensors(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"sensor_id": "s", "bands": [{"band_id": "blue", "response_definition": {"kind": "sampled", "wavelength_nm": [445, 450, 455], "response": [0.2, 1.0, 0.2]}},\n{"band_id": "far", "response_definition": {"kind": "band_spec", "center_wavelength_nm": 1600, "fwhm_nm": 20}}]}')
    rows = tables.read_sensors(spark, str(tmp_path)).orderBy("band_index").collect()
    assert [(r.band_id, r.segment) for r in rows] == [("blue", "vnir"), ("far", "swir")] and rows[0].center_nm == pytest.approx(450)


def test_quotes_auxiliary_columns_and_guards():
    (s,) = T.parsed(b'sample_id,site,400,401,402\n"a, x",s1,0.1,0.2,0.3\n', "q.csv")
    assert (s.sample_name, s.values, s.metadata) == ("a, x", [0.1, 0.2, 0.3], {"sample_id": "a, x", "site": "s1"})
    found = T.parsed(b"Wavelength,leaf,leaf_std,rmse\n400,0.1,0.01,9\n401,0.2,0.02,9\n402,0.3,0.03,9\n", "c.csv")
    assert [s.sample_name for s in found] == ["leaf"]
    assert [s.sample_name for s in T.parsed(b"wl,std,err\n400,1,2\n401,1,2\n", "c.csv")] == ["std", "err"]  # nothing else is there
    (s,) = T.parsed(b"sample_name,400,401,402,403_std\na,0.1,0.2,0.3,0.4\n", "r.csv")
    assert s.wavelengths_nm == [400, 401, 402]
    (s,) = T.parsed(b"name,400,401,402,X403,300\na,1,2,3,4,5\n", "r.csv", "cabo_leaf_v2")
    assert s.wavelengths_nm == [400, 401, 402]


def test_long_tables():
    lines = b"# made\nrecord,wavelength,R,observation_ID\n1,400,0.1,u\n2,410,0.2,u\n3,400,,v\n4,400,0.3,v\n5,410,0.4,v\n6,400,0.5,u\n"
    found = T.parsed(lines, "l.csv")
    assert [(s.sample_name, s.values) for s in found] == [("u", [0.1, 0.2]), ("v", [0.3, 0.4]), ("u", [0.5])]
    alone = T.parsed(b"wavelength,lambda2,reflectance\n400,x,0.1\n410,x,0.2\n420,y,0.3\n", "n.csv")
    assert {s.parser for s in alone} <= {"csv_long_table", "csv_column_wide"}
    rows = T.tabular([["note", "wl", "value"], ["a", "400", "1"], ["b", "410", "2"]])
    assert [(s.sample_name, s.values) for s in rows] == [("spectrum_00001", [1]), ("spectrum_00002", [2])]  # no sample column


def test_records_pairs_and_comments():
    body = "splib07b Record=7: Quartz sand\n" + "\n".join(["0.5"] * 999 + ["-1.23e34"])
    (s,) = T.parsed(body.encode(), "u.txt")
    assert (s.parser, s.sample_name, s.wavelengths_nm[0], s.wavelengths_nm[-1]) == ("usgs_ascii", "Quartz sand", 350, 1349) and s.values[-1] != s.values[-1]
    assert T.parsed(b"Record=7: short\n1\n2\n", "u.txt") == []
    (s,) = T.parsed(b"My leaf\nwavelength (nm) reflectance\n400 0.1\n401 0.2\n", "p.txt")
    assert (s.parser, s.sample_name, s.values) == ("text_pairs", "My leaf", [0.1, 0.2])
    (s,) = T.parsed(b"/* header\nmore */\n# x\nwl,a\n400,1\n401,2\n", "c.csv")
    assert s.values == [1, 2]


def test_scales_and_cleaning():
    assert T.scale_hint("ossl", "x", [1.0]) == 100 and T.scale_hint("x", "x", [1.0]) is None
    assert T.scale_hint(T.PACKAGE_SOURCE, f"a/{T.PACKAGE_FILE}", [50.0] * 200 + [900.0]) == 100
    assert [T.scale_of(v, None) for v in ([1.5], [100.5], [1000.5], [20000.5], [20001.0])] == [1, 100, 1000, 10000, 1] and T.scale_of([5.0], 7.0) == 7
    w, v, s = T.clean([410, 400, 400 + 1e-10, None, 420], [20.0, 1.0, 2.0, 3.0, float("nan")])
    assert (w, v, s) == ([400, 410], [0.02, 0.2], 100)
    with pytest.raises(ValueError, match="fewer than two"):
        T.clean([400], [1.0])
    with pytest.raises(ValueError, match="collapsed"):
        T.clean([400, 400], [1.0, 2.0])
    assert T.median_spacing([1, 2, 2, 5, 6]) == 1 and T.median_spacing([1]) is None and T.nearest_rank([3, 1, 2], 0.25) == 1
    assert T.auxiliary("leaf_STDEV") and not T.auxiliary("standard") and T.nanometres([0.4, 2.5], "") == [400, 2500] and T.nanometres([4e-7], "meters") == pytest.approx([400])


FAULTS = {
    "sample_id,band_id,reflectance\n,blue,1\n": "sample_id", "sample_id,band_id,reflectance\na,,1\n": "band_id", "sample_id,band_id,reflectance\na,blue,x\n": "numbers", "sample_id,band_id,reflectance\na,blue,\n": "numbers",
    "sample_id,band_id,reflectance,valid\na,blue,1,maybe\n": "flag", "sample_id,band_id,reflectance\na,blue,1\na,blue,2\n": "twice", "sample_id,band_id,reflectance,exclude_row_id\na,blue,1,r\na,swir,2,q\n": "differs",
    "sample_id,blue\n,1\n": "sample_id", "sample_id,blue\na,x\n": "numbers", "sample_id,blue\na,\n": "needs a value", "sample_id,blue\na,1\na,2\n": "must differ", "sample_id,valid_blue\na,1\n": "band column", "sample_id,red,valid_blue\na,1,1\n": "need their band",
    "sample_id,blue,valid_blue\na,1,perhaps\n": "flag", "sample_id,blue\n": "no rows",
}


@pytest.mark.parametrize("text", sorted(FAULTS))
def test_faulty_queries_are_coded_errors(spark, tmp_path, text):
    (tmp_path / "q.csv").write_text(text)
    with pytest.raises(CodedError, match=FAULTS[text]) as e:
        tables.read_queries(spark, str(tmp_path / "q.csv"), ["blue", "swir"])
    assert e.value.code == "invalid_input_csv"


def test_query_order_ids_and_one_sample(spark, tmp_path):
    (tmp_path / "w.csv").write_text("blue,other\n0.1,9\n0.2,8\n")
    rows = [tuple(r) for r in tables.queries_with_index(spark, str(tmp_path / "w.csv"), ["blue", "swir"]).orderBy("sample_index").collect()]
    assert rows == [("sample_000001", None, [0.1, None], [True, False], 0), ("sample_000002", None, [0.2, None], [True, False], 1)]
    (tmp_path / "l.csv").write_text("sample_id,band_id,reflectance\nz,blue,1\na,blue,2\nz,swir,3\n")
    long = tables.queries_with_index(spark, str(tmp_path / "l.csv"), ["blue", "swir"]).orderBy("sample_index").collect()
    assert [(r.sample_id, r["values"]) for r in long] == [("z", [1, 3]), ("a", [2, None])]
    (tmp_path / "one.csv").write_text("band_id,reflectance,valid\nblue,0.8,\nswir,0.2,no\n")
    assert tables.read_query(spark, str(tmp_path / "one.csv")) == ({"blue": 0.8, "swir": 0.2}, {"blue": True, "swir": False})
    (tmp_path / "two.csv").write_text("blue,swir\n0.8,\n")
    assert tables.read_query(spark, str(tmp_path / "two.csv")) == ({"blue": 0.8}, None)
    with pytest.raises(CodedError) as e:
        tables.read_query(spark, str(tmp_path / "none.csv"))
    assert e.value.code == "missing_input_file" and tables.strict_flag(" YES ") and not tables.strict_flag("0")
    (tmp_path / "t.csv").write_text("a,b\n1,x\n,\n")
    assert [tuple(r) for r in tables.read_typed(spark, str(tmp_path / "t.csv"), "a double, b string").collect()] == [(1.0, "x"), (None, None)]
    assert tables.read_inferred(spark, str(tmp_path / "t.csv")).dtypes == [("a", "int"), ("b", "string")]
