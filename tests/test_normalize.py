"""Binary readers on files made here, archives, and the normalising job."""

import gzip
import json
import struct
import zipfile

import numpy as np
import pytest

from prismora.sources import binary_spectra as B
from prismora.sources import normalize as N

HEADER = "ENVI\nfile type = ENVI Spectral Library\nsamples = 3\nlines = 2\nbands = 1\ndata type = {t}\nbyte order = {o}\ninterleave = bsq\nwavelength units = Micrometers\nwavelength = { 0.4, 0.5,\n 0.6 }\nspectra names = {leaf, soil}\nreflectance scale factor = 100\n"


def envi_files(code, dtype, order):
    values = np.array([[1, 2, 3], [4, 5, 6]])
    return HEADER.replace("{t}", str(code)).replace("{o}", str(order)), values.astype((">" if order else "<") + dtype).tobytes()


@pytest.mark.parametrize(("code", "dtype"), sorted(B.ENVI_TYPES.items()))
@pytest.mark.parametrize("order", [0, 1])
def test_envi(code, dtype, order):
    text, data = envi_files(code, dtype, order)
    a, b = B.envi(B.envi_header(text.encode()), data, "x.hdr", "x.sli")
    assert (a.sample_name, b.sample_name, b.values, a.value_scale_hint) == ("leaf", "soil", [4, 5, 6], 100) and a.wavelengths_nm == pytest.approx([400, 500, 600])


def test_envi_faults():
    text, data = envi_files(4, "f4", 0)
    h = B.envi_header(text.encode())
    for change, part in (({"data type": "99"}, "data type"), ({"file type": "", "interleave": "bil"}, "layout"), ({"wavelength": []}, "wavelength"), ({"lines": "3"}, "length")):
        with pytest.raises(ValueError, match=part):
            B.envi({**h, **change}, data, "x.hdr", "x")
    assert B.envi_companions("a/b.hdr", {"data file": "c.bin"}) == ["a/b", "a/b.sli", "a/b.img", "a/c.bin"]


def xlsx(path, sheets):
    """A workbook of {name: rows}, written by hand."""
    ref = lambda r, c: f"{chr(65 + c)}{r + 1}"
    strings = sorted({v for rows in sheets.values() for r in rows for v in r if isinstance(v, str)})
    cell = lambda r, c, v: f'<c r="{ref(r, c)}" t="s"><v>{strings.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{ref(r, c)}"><v>{v}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_spreadsheets(tmp_path):
    xlsx(tmp_path / "w.xlsx", {
        "bands": [["Plot ID", None, "P1", "P2", "P3"], ["Julian day", None, 120, 121, 122], [None, "band", "reflectance", "reflectance", "reflectance"], [None, 400, 0.1, 0.2, 0.3], [None, 401, 0.4, 0.5, 0.6]],
        "mean": [["notes"], ["wavelength", "mean", "std"], [400, 0.1, 9], [401, 0.2, 9], [402, 0.3, 9]], "wide": [["sample_name", 400, 401, 402], ["a", 0.1, 0.2, 0.3]], "empty": [],
    })
    found = B.spreadsheet((tmp_path / "w.xlsx").read_bytes(), "", "w.xlsx")
    assert [(s.parser, s.sample_name, s.part) for s in found] == [("xlsx_band_matrix", f"P{k}_jd{119 + k}", "bands") for k in (1, 2, 3)] + [("xlsx_sheet_mean_curve", "mean", "mean"), ("xlsx_row_wide", "a", "wide")]
    assert found[1].values == [0.2, 0.5] and found[3].values == [0.1, 0.2, 0.3] and found[0].metadata["plot id"] == "P1"


class R:
    """Writes the little of R's serialisation that the reader is tried on."""

    def __init__(self):
        self.b = b"X\n" + struct.pack(">3i", 2, 0x30500, 0x20300)

    def i(self, *v):
        self.b += struct.pack(f">{len(v)}i", *v)
        return self

    def char(self, s):
        self.i(9 | 64 << 12, len(s))
        self.b += s.encode()

    def strings(self, values):
        self.i(16, len(values))
        for v in values:
            self.char(v)

    def reals(self, values):
        self.i(14, len(values))
        self.b += struct.pack(f">{len(values)}d", *values)

    def attributes(self, **given):
        for name, values in given.items():
            self.i(2 | 1 << 10, 1)
            self.char(name)
            self.strings(values) if isinstance(values[0], str) else self.i(13, len(values), *values)
        self.i(254)


def test_data_frames():
    r = R()
    r.i(19 | 1 << 9, 4)
    r.strings(["a", "b"]), r.reals([0.1, 0.2]), r.reals([0.3, float("nan")])
    r.i(13 | 1 << 9, 2, 2, 1)  # a factor
    r.attributes(levels=["x", "y"])
    r.attributes(names=["sample_name", "X400", "X401", "kind"], **{"row.names": [1, 2]}, **{"class": ["data.frame"]})
    with pytest.raises(ValueError):
        B.data_frame(b"nothing", "", "f.rds")
    wide = r.b
    assert B.data_frame(gzip.compress(wide), "", "f.rds") == B.data_frame(wide, "", "f.rds")
    a, b = B.data_frame(wide, "", "f.rds")
    assert (a.sample_name, a.values, a.metadata["kind"], b.values) == ("a", [0.1, 0.3], "y", [0.2])


def netcdf3(dims, variables, attributes):
    """A classic file: dims {name: size}, variables {name: (dims, values, units)}."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    atts = lambda d: struct.pack(">2i", 12 if d else 0, len(d)) + b"".join(name(k) + struct.pack(">2i", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4) for k, v in d.items())
    order = list(dims)
    bodies = [np.asarray(v, ">f8").tobytes() for _, v, _ in variables.values()]

    def head(begin):
        out = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">2i", 10, len(dims)) + b"".join(name(n) + struct.pack(">i", s) for n, s in dims.items()) + atts(attributes) + struct.pack(">2i", 11, len(variables))
        for (n, (ds, _, units)), body in zip(variables.items(), bodies):
            out += name(n) + struct.pack(f">i{len(ds)}i", len(ds), *[order.index(d) for d in ds]) + atts({"units": units} if units else {}) + struct.pack(">3i", 6, len(body), begin)
            begin += len(body)
        return out

    return head(len(head(0))) + b"".join(bodies)


def test_netcdf():
    data = netcdf3({"obs": 2, "wavelength": 3}, {"wavelength": (["wavelength"], [0.4, 0.5, 0.6], "um"), "rrs_error": (["obs", "wavelength"], [[9, 9, 9]] * 2, ""), "Rrs": (["obs", "wavelength"], [[1, 2, 3], [4, 5, 6]], "")}, {"title": "sea"})
    a, b = B.netcdf(data, "d/sea.nc")
    assert (a.sample_name, b.sample_name, b.values, b.metadata["obs_index"], b.metadata["attr:title"]) == ("sea_00001", "sea_00002", [4, 5, 6], "1", "sea") and a.wavelengths_nm == pytest.approx([400, 500, 600])
    (one,) = B.netcdf(netcdf3({"wavelength": 2}, {"wavelength": (["wavelength"], [400, 500], "nm"), "mean_reflectance": (["wavelength"], [0.1, 0.2], "")}, {}), "x.nc")
    assert one.values == [0.1, 0.2]
    for bad in (b"\x89HDF", netcdf3({"x": 1}, {"x": (["x"], [1], "")}, {}), netcdf3({"wavelength": 1}, {"wavelength": (["wavelength"], [1], "")}, {})):
        with pytest.raises(ValueError):
            B.netcdf(bad, "x.nc")


TABLE = "sample_name,400,401,402\na,0.1,0.2,0.3\nb,0.4,0.5,0.6\n"


def test_archives_and_skips(tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.csv", TABLE)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n in ("a_other.csv", "b_spectra.csv", "readme.csv", "x.metadata.csv", "__MACOSX/c.csv", ".hidden.csv", "notes.doc"):
            z.writestr(n, TABLE)
        z.writestr("inner.zip", inner.read_bytes())
    paths = [p.split("::", 1)[1] for p, _ in N.archive("z.zip", (tmp_path / "z.zip").read_bytes(), "")]
    assert paths == ["b_spectra.csv"] * 2 + ["a_other.csv"] * 2 + ["inner.zip::deep.csv"] * 2
    axis = "x Record=1\n" + "\n".join(str(0.35 + k / 1000) for k in range(1000))
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("s/leaf.txt", "t Record=5: leaf\n" + "0.5\n" * 1000)
        z.writestr("s/Wavelengths_ASD.txt", axis)
        z.writestr("s/errorbars/leaf.txt", "t Record=6: e\n" + "0.5\n" * 1000)
    ((_, s),) = N.archive("u.zip", (tmp_path / "u.zip").read_bytes(), "usgs_v7")
    assert s.wavelengths_nm[1] == pytest.approx(351)
    assert N.skipped("cabo_leaf_v2", "x/other.csv") and not N.skipped("cabo_leaf_v2", "x/ref_spec.csv") and N.skipped("usgs_v7", "a/errorbars/x.txt") and N.skipped("understory_icos_europe", "pisek_et_al_2021_bg_table1.csv") and not N.skipped("", "x.csv")


def test_the_job(spark, tmp_path):
    text, data = envi_files(4, "f4", 0)
    s1 = tmp_path / "r" / "s1"
    (s1 / "data" / "sub").mkdir(parents=True), (s1 / "metadata").mkdir()
    (s1 / "data" / "lib.hdr").write_text(text), (s1 / "data" / "lib.sli").write_bytes(data)
    (s1 / "data" / "sub" / "t.csv").write_text(TABLE), (s1 / "data" / "b.pdf").write_text("x"), (s1 / "data" / "bad.zip").write_text("x"), (s1 / "data" / "e.txt").write_text("\n")
    (s1 / "data" / "lone.hdr").write_text(text), (s1 / "short.csv").write_text("sample_name,400,401,402\nz,0.1,,\n"), (s1 / "metadata" / "m.csv").write_text(TABLE)
    for name, status in (("s1", "downloaded"), ("s2", "metadata_only"), ("s3", "downloaded")):
        (tmp_path / "r" / name).mkdir(exist_ok=True)
        (tmp_path / "r" / name / "fetch-result.json").write_text(json.dumps({"source_id": name, "status": status}))
    manifest = spark.createDataFrame([(n, n.upper(), "primary") for n in ("s1", "s2", "s3", "s4")], "source_id string, name string, ingest_role string")
    made = N.normalize(spark, manifest, f"file://{tmp_path}/r", checkpoint=f"file://{tmp_path}/parsed")
    done = N.write(spark, made, f"file://{tmp_path}/out")
    assert done["downloaded_sources"] == 2 and done["normalized_sources"] == 1 and done["normalized_spectra"] == 4 and done["parser_counts"] == {"csv_row_wide": 2, "envi_binary": 2}
    rows = {r.spectrum_id: r for r in made["spectra_metadata"].collect()}
    assert [rows[f"s1_{k:06d}"].sample_name for k in range(1, 5)] == ["leaf", "soil", "a", "b"]
    assert rows["s1_000001"].value_scale_applied == 100 and rows["s1_000001"].native_spacing_nm == pytest.approx(100) and rows["s1_000003"].normalized_points == 3 and json.loads(rows["s1_000003"].metadata_json) == {"sample_name": "a"}
    values = made["normalized_spectra"].where("spectrum_id = 's1_000001'").first()["values"]
    assert len(values) == 2101 and values[0] == pytest.approx(0.01) and values[50] == pytest.approx(0.015) and values[201] is None
    failures = {(r.input_path.rsplit("/", 1)[-1], r.stage): r.reason for r in made["normalization_failures"].collect()}
    assert failures["b.pdf", "dispatch"] == "unsupported file type .pdf" and failures["e.txt", "parse"] == "no spectra detected" and "companion" in failures["lone.hdr", "parse"] and "fewer than two" in failures["short.csv", "normalize"] and failures["s3", "scan"] == "missing data directory" and ("bad.zip", "parse") in failures and len(failures) == 6
    assert {r.source_id: (r.normalized_spectra, r.failure_count, r.parsers) for r in made["source_summary"].collect()} == {"s1": (4, 5, "csv_row_wide:2 | envi_binary:2"), "s3": (0, 1, "")}
