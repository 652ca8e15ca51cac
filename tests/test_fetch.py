"""Fetch adapters against canned replies."""

import io
import json
import zipfile
from pathlib import Path

import pytest

from prismora.errors import CodedError
from prismora.sources import fetch as F


class Canned(F.Http):
    """Replies by address; lists are given one after another."""

    def __init__(self, **replies):
        self.replies = replies["pages"]

    def get(self, url, form=None):
        body = self.replies.get(url if form is None else f"{url}?{form['searchtype']}&{form['classsel']}&{form['maxhits']}")
        if body is None:
            raise FileNotFoundError("HTTP 404")
        media = "text/html" if isinstance(body, str) else "application/zip" if isinstance(body, bytes) else "application/json"
        return F.Reply(url, body.encode() if isinstance(body, str) else body if isinstance(body, bytes) else json.dumps(body).encode(), media)


def run(tmp_path, adapter, pages, assets=True, landing="http://l", download="", **more):
    s = {"source_id": "s", "name": "S", "fetch_adapter": adapter, "landing_url": landing, "download_url": download}
    http = Canned(pages=pages)
    for k, v in more.items():
        setattr(http, k, v)
    r = F.fetch(s, f"file://{tmp_path}", assets, http)
    assert json.loads((tmp_path / "s" / "fetch-result.json").read_text()) == r
    for a in r["artifacts"]:
        assert not a["path"] or Path(a["path"].removeprefix("file://")).stat().st_size == a["size_bytes"]
    return r, [(a["kind"], a["path"].split("/s/")[-1], a["status"]) for a in r["artifacts"]]


def archive():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in ("repo-main/data/a.csv", "repo-main/data/sub/b.csv", "repo-main/readme.md", "repo-main/data/"):
            z.writestr(n, n)
    return b.getvalue()


def test_plain_addresses(tmp_path):
    r, files = run(tmp_path, "static_http", {"http://d/x.zip": b"zip", "http://l": "<html>"}, download="http://d/x.zip")
    assert r["status"] == "downloaded" and ("data", "data/x.zip", "downloaded") in files
    r, files = run(tmp_path, "static_http", {"http://l": "<html>"}, download="http://d/gone.zip")
    assert r["status"] == "metadata_only" and len(r["notes"]) == 2
    with pytest.raises(FileNotFoundError):
        run(tmp_path, "static_http", {})
    assert run(tmp_path, "static_http", {"http://l": "<html>"}, assets=False)[0]["status"] == "metadata_only"
    assert run(tmp_path, "manual_portal", {})[0]["status"] == "manual_review"
    with pytest.raises(CodedError):
        run(tmp_path, "nothing", {})


def test_records(tmp_path):
    files = [{"key": "a.csv", "links": {"self": "http://z/a"}}, {"key": "b.csv", "links": {"self": "http://z/b"}, "size": 5}]
    pages = {F.ZENODO + "12": {"files": files}, "http://z/a": b"A", "http://z/b": b"B", "http://q/files/c%20d.csv/content": b"C"}
    assert [x[1:] for x in run(tmp_path, "zenodo_api", pages, landing="http://x/records/12")[1][1:]] == [("data/a.csv", "downloaded"), ("data/b.csv", "downloaded")]
    assert [x[2] for x in run(tmp_path, "zenodo_api", pages, landing="http://x/records/12", download="http://z/b")[1][1:]] == ["discovered", "downloaded"]
    assert run(tmp_path, "zenodo_api", pages, landing="http://x/records/12", download="http://q/files/c d.csv/content")[1][-1][1] == "data/c d.csv"
    assert {x[2] for x in run(tmp_path, "zenodo_api", pages, assets=False, landing="http://x/records/12")[1][1:]} == {"discovered"}
    pages = {F.ECOSIS + "pk": {"ecosis": {"resources": [{"url": "http://ecosis.org/r.csv", "name": "r.csv"}]}}, "https://ecosis.org/r.csv": b"R", F.ECOSIS + "no": {}, F.ECOSIS + "no/export?metadata=true": b"E"}
    assert [x[1:] for x in run(tmp_path, "ecosis_package", pages, landing="http://e/package/pk")[1][1:]] == [("data/r.csv", "downloaded"), ("", "discovered")]
    assert run(tmp_path, "ecosis_package", pages, landing="http://e/package/no")[1][1][1] == "data/no.csv"
    data = {"files": [{"filename": "m.csv", "content_details": {"download_url": "http://m/1"}}]}
    pages = {F.MENDELEY + "ab?version=2": {"files": []}, F.MENDELEY + "ab": data, "http://m/1": b"M"}
    r, found = run(tmp_path, "mendeley_public", pages, landing="http://d/datasets/ab/2")
    assert found[1][1] == "data/m.csv" and "version" in r["notes"][0]
    with pytest.raises(ValueError):
        run(tmp_path, "mendeley_public", pages, landing="http://d/other")


def test_catalogues(tmp_path):
    pages = {F.NEON + "DP1": {"data": {"siteCodes": [{"siteCode": "S", "availableDataUrls": ["http://n/1"]}]}}, "http://n/1": {"data": {"month": "2020-01", "files": [{"name": "FSP_a.csv", "url": "http://n/a", "size": "3"}, {"name": "other.csv", "url": "http://n/o"}]}}, "http://n/a": b"N"}
    assert run(tmp_path, "neon_api", pages, landing="http://n/data-products/DP1")[1][-1][1:] == ("data/FSP_a.csv", "downloaded")
    pages = {"http://l": '<a href="https://doi.org/10.1594/PANGAEA.7">', "https://doi.pangaea.de/10.1594/PANGAEA.7": "<a href='?format=zip'>", "https://doi.pangaea.de/10.1594/PANGAEA.7?format=zip": b"P"}
    assert run(tmp_path, "pangaea", pages)[1][-1][1] == "data/s.zip" and run(tmp_path, "pangaea", {"http://l": "no links"})[0]["status"] == "metadata_only"
    q = f"{F.DATAONE}query/solr/?q=10.5440/9&fl=id,identifier,seriesId,formatId,title,documents&rows=20&wt=json"
    xml = lambda i, f, n: f"<identifier>{i}</identifier><formatId>{f}</formatId><fileName>{n}</fileName><size>4</size>"
    pages = {q: {"response": {"docs": [{"id": "m", "documents": ["m", "d"]}]}}, F.DATAONE + "meta/m": xml("m", "x", "m.xml"), F.DATAONE + "meta/d": xml("d", "text/csv", "d.csv"), F.DATAONE + "resolve/d": b"D"}
    assert [x[1] for x in run(tmp_path, "ess_dive_dataone", pages, landing="http://e/biblio/9")[1][1:]] == ["data/d.csv"]
    many = "".join(f'<input value="c/f{k:03d}.txt">' for k in range(100))
    S = F.ECOSTRESS_SEARCH
    pages = {F.ECOSTRESS_PAGE: "javascript:orderall('soil')", f"{S}?soil&All&100": '<select name="classsel"><option value="All"><option value="x"></select>', f"{S}?soil&x&100": many, f"{S}?soil&x&200": many + '<input value="c/last.txt">', f"{S}?soil&x&300": many + '<input value="c/last.txt">'}
    pages |= {F.ECOSTRESS_DATA + f"c/f{k:03d}.txt": b"t" for k in range(100)} | {F.ECOSTRESS_DATA + "c/last.txt": b"t"}
    r, found = run(tmp_path, "ecostress_web", pages)
    assert len(found) == 102 and found[-1][1] == "data/last.txt"


def test_archives_clients_and_tidying(tmp_path):
    r, found = run(tmp_path, "github_archive", {"http://g/z": archive()}, download="http://g/z#data")
    assert [x[1] for x in found[1:]] == ["data/a.csv", "data/sub/b.csv"] and r["status"] == "downloaded"

    class Client:
        def spaces(self, conditions):
            return [([400, 401], "refl", [("x", [0.1, 0.2])])]

    c = [{"attribute": "a", "operator": "=", "value": "1"}]
    assert run(tmp_path, "specchio_client", {}, client=Client(), conditions=c)[1][-1][1] == "data/space_001.csv"
    assert (tmp_path / "s" / "data" / "space_001.csv").read_text() == "spectrum_id,measurement_unit,400,401\nx,refl,0.1,0.2\n"
    assert run(tmp_path, "specchio_client", {})[0]["status"] == "manual_review"
    (tmp_path / "s" / "loose.csv").write_text("x"), (tmp_path / "s" / "note.pdf").write_text("x")
    counts = F.tidied(f"file://{tmp_path}/s")
    assert (tmp_path / "s" / "data" / "loose.csv").exists() and (tmp_path / "s" / "docs" / "note.pdf").exists() and counts["docs"] == 1


def test_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", "A", "manual_portal", "http://l", ""), ("b", "B", "static_http", "http://gone", "")], "source_id string, name string, fetch_adapter string, landing_url string, download_url string")
    done = {r.source_id: (r.status, r.error) for r in F.fetch_all(spark, rows, f"file://{tmp_path}", True, None).collect()}
    assert done["a"] == ("manual_review", None) and done["b"][0] == "error" and json.loads((tmp_path / "b" / "fetch-result.json").read_text())["status"] == "error"
    full = rows.selectExpr("*", "'t1' as tier", "'x' as status", "'' as auth_mode", "'' as expected_format")
    m = F.matrix(full, fetch_adapter=["manual_portal"])
    assert [r["source_id"] for r in m["include"]] == ["a"] and len(m["manifest_sha256"]) == 64
