"""Fetching of sources: an adapter says what a source has, the engine writes it down and downloads it.

An adapter gives documents (metadata, written as JSON), files (address and name) and notes for one manifest row; it
speaks to the network through a transport, so tests need none. `fetch_all` runs sources in parallel Spark tasks, which
write into a folder they share; one that fails leaves an error result and the others go on.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from urllib.error import HTTPError
from urllib.parse import quote, unquote, urlencode, urljoin, urlsplit, urlunsplit
from urllib.request import Request, urlopen

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..errors import DOWNLOAD, CodedError

AGENT = "prismora/0"

# Endpoints, patterns, suffixes and names of the providers.
ZENODO, ECOSIS, NEON, MENDELEY = "https://zenodo.org/api/records/", "https://ecosis.org/api/package/", "https://data.neonscience.org/api/v0/products/", "https://data.mendeley.com/public-api/datasets/"
DATAONE = "https://cn.dataone.org/cn/v2/"
ECOSTRESS_PAGE, ECOSTRESS_SEARCH, ECOSTRESS_DATA = "https://speclib.jpl.nasa.gov/download", "https://speclib.jpl.nasa.gov/ecospeclib_list", "https://speclib.jpl.nasa.gov/ecospeclibdata/"
ECOSTRESS_TYPES = "lunar manmade meteorites mineral nonphotosyntheticvegetation rock soil vegetation water"
PANGAEA_DOI = r"https?://(?:doi\.pangaea\.de|doi\.org)/10\.1594/PANGAEA\.\d+"
PANGAEA_FILE = r"https?://download\.pangaea\.de/[^\"']+"
DOWNLOADS = ".zip .gz .tgz .tar .bz2 .csv .tsv .txt .json .xlsx .xls .nc .pdf .hdr .sli .asd"
DOCS, RECORDS = ".pdf .docx .md .html .htm", ".json .xml .rdf"


@dataclass
class Reply:
    url: str
    body: bytes
    media_type: str = "application/octet-stream"
    headers: dict[str, str] = field(default_factory=dict)
    status: int = 200

    def text(self) -> str:
        return self.body.decode("utf-8", "ignore")

    def json(self) -> object:
        return json.loads(self.body)


class Http:
    """The network; get() raises FileNotFoundError for an HTTP error, with the code in its text."""

    def __init__(self, agent: str = AGENT, timeout: int = 300) -> None:
        self.agent, self.timeout = agent, timeout

    def get(self, url: str, form: Mapping[str, str] | None = None) -> Reply:
        request = Request(url, data=urlencode(form).encode() if form else None, headers={"User-Agent": self.agent})
        try:
            with urlopen(request, timeout=self.timeout) as r:
                return Reply(r.geturl(), r.read(), r.headers.get_content_type(), dict(r.headers.items()), r.status)
        except HTTPError as e:
            raise FileNotFoundError(f"HTTP {e.code}") from e


@dataclass
class Remote:
    """A file of a source. Its body may be known already; part: folder under the source's."""

    url: str
    name: str
    media_type: str = ""
    size: int = 0
    sha256: str = ""
    note: str = ""
    body: bytes | None = None
    part: str = ""
    wanted: bool = True


@dataclass
class Found:
    documents: dict[str, object] = field(default_factory=dict)
    files: list[Remote] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    status: str | None = None  # if not by what was downloaded


Adapter = Callable[[Mapping[str, str], Http, bool], Found]


def now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def safe_name(name: str) -> str:
    return name.replace("/", "_").replace("\\", "_").strip() or "artifact.bin"


def name_of(url: str, fallback: str) -> str:
    return safe_name(os.path.basename(urlsplit(url).path) or fallback)


def _part(url: str, pattern: str, what: str) -> str:
    m = re.search(pattern, url)
    if not m:
        raise ValueError(f"no {what} in {url}")
    return m[1]


def static_http(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """The configured file, or the landing page where it fails or none is configured."""
    out, url = Found(), s["download_url"] if assets and s["download_url"] else s["landing_url"]
    try:
        r = http.get(url)
    except FileNotFoundError as e:
        if url == s["landing_url"]:
            raise
        out.notes.append(f"The download address gave {e}; the landing page was read.")
        url = s["landing_url"]
        r = http.get(url)
    out.documents["http_response"] = {"requested_url": url, "landing_url": s["landing_url"], "download_url": s["download_url"], "final_url": r.url, "status": r.status, "media_type": r.media_type, "headers": r.headers}
    suffix = os.path.splitext(urlsplit(r.url).path)[1].lower()
    if assets and (suffix in DOWNLOADS.split() or not r.media_type.startswith("text/html")):
        out.files.append(Remote(r.url, name_of(r.url, f"{s['source_id']}.bin"), r.media_type, body=r.body))
    elif assets:
        out.notes.append("The address gave a page and no file; it must be resolved by hand.")
    return out


def zenodo(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """All files of a record, or the configured one."""
    clean = lambda u: urlunsplit((p := urlsplit(u))._replace(path=quote(unquote(p.path))))
    record = http.get(ZENODO + _part(s["landing_url"], r"/records/(\d+)", "record")).json()
    out, only, hit = Found({"zenodo_record": record}), clean(s["download_url"]) if s["download_url"] else "", False
    content = lambda u: safe_name(unquote(urlsplit(u).path).split("/files/", 1)[1].rsplit("/content", 1)[0]) if "/files/" in u and urlsplit(u).path.endswith("/content") else ""
    for k, f in enumerate(record.get("files", []), 1):
        urls = [clean(str(u)) for u in (f.get("links", {}).get("self"), f.get("links", {}).get("download")) if u]
        first = urls[0] if urls else ""
        wanted = bool(first) and (not only or only in urls)
        hit = hit or (bool(only) and wanted)
        name = safe_name(str(f.get("key") or content(first) or name_of(first, f"file-{k}.bin")))
        out.files.append(Remote(first, name, f.get("mimetype", ""), int(f.get("size") or 0), f.get("checksum", ""), name, wanted=wanted))
    if assets and only and not hit:
        if content(only):
            out.files.append(Remote(only, content(only)))
            out.notes.append("The configured file is not in the record; it was downloaded directly.")
        else:
            out.notes.append("The configured address is no file of the record.")
    return out


def ecosis(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """All resources of a package; its export where it lists none."""
    https = lambda u: "https" + u[4:] if re.match(r"http://(data\.)?ecosis\.org/", u) else u
    slug = _part(s["landing_url"], r"/package/([^?#]+)", "package").strip("/")
    package = http.get(ECOSIS + slug).json()
    export = f"{ECOSIS}{slug}/export?metadata=true"
    inner = package.get("ecosis") if isinstance(package, dict) else None
    given = (inner if isinstance(inner, dict) else {}).get("resources")
    held = [r for r in (given if isinstance(given, list) else []) if isinstance(r, dict) and r.get("url")]
    files = [Remote(https(str(r["url"])), safe_name(str(r.get("name") or name_of(https(str(r["url"])), "resource.bin"))), str(r.get("mimetype") or "")) for r in held]
    own = https(s["download_url"]) if s["download_url"] else ""
    if held and own and own not in [f.url for f in files]:
        files.append(Remote(own, name_of(own, f"{s['source_id']}.bin")))
    elif not held:
        files = [Remote(own or export, name_of(own, f"{slug}.csv") if own else f"{slug}.csv")]
    listed = Remote(export, "package_export.csv", "text/csv", note="export with metadata", wanted=False)
    return Found({"ecosis_package": {"package_slug": slug, "export_url": export, "resource_count": len(held), "package": package}}, [*files, listed])


def ecostress(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """Every text file that the search lists by type and class, page after page."""
    uniq = lambda xs: list(dict.fromkeys(xs))
    ask = lambda t, c, n: http.get(ECOSTRESS_SEARCH, {"searchtype": t, "classsel": c, "subclass": "All", "mname": "", "xstart": "", "xstop": "", "maxhits": str(n), "wavelength": "Any"}).text()
    types = uniq(t for t in re.findall(r"javascript:orderall\('([^']+)'\)", http.get(ECOSTRESS_PAGE).text()) if t != "spectra") or ECOSTRESS_TYPES.split()
    names, classes = [], []
    for t in types:
        box = re.search(r'<select name="classsel".*?>(.*?)</select>', ask(t, "All", 100), re.S)
        for c in uniq(v for v in re.findall(r'<option value="([^"]+)"', box[1] if box else "") if v != "All") or ["All"]:
            own, seen, most = [], set(), 100
            while True:
                page = tuple(uniq(re.findall(r'value="([^"]+\.txt)"', ask(t, c, most))))
                if not page or page in seen:
                    break
                seen.add(page)
                before, own = len(own), uniq([*own, *page])
                if len(page) < 100 or len(own) == before:
                    break
                most += 100
            names += own
            classes.append({"search_type": t, "class_value": c, "file_count": len(own)})
    names = sorted(set(names))
    return Found({"ecostress_catalog": {"search_types": types, "classes": classes, "total_files": len(names)}}, [Remote(urljoin(ECOSTRESS_DATA, n), name_of(n, n), "text/plain", note=n) for n in names], [f"{len(names)} files are listed."])


def ess_dive(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """Data members of the package that a DOI names."""
    m = re.search(r"10\.5440/\d+", s["landing_url"]) or re.search(r"/biblio/(\d+)", s["landing_url"])
    if not m:
        raise ValueError(f"no DOI in {s['landing_url']}")
    doi = m[0] if m[0].startswith("10.") else f"10.5440/{m[1]}"
    docs = http.get(f"{DATAONE}query/solr/?q={quote(doi)}&fl=id,identifier,seriesId,formatId,title,documents&rows=20&wt=json").json().get("response", {}).get("docs", [])
    if not docs:
        raise ValueError(f"no package for {doi}")
    own, members, files = str(docs[0].get("id") or docs[0].get("identifier") or ""), [], []
    for d in map(str, docs[0].get("documents", [])):
        xml = http.get(f"{DATAONE}meta/{quote(d, safe='')}").text()
        tag = lambda n: (re.search(f"<{n}>(.*?)</{n}>", xml) or ["", ""])[1]  # noqa: B023, E731
        kind, name, size = tag("formatId"), tag("fileName"), tag("size")
        about = tag("identifier") == own or kind.startswith("https://eml.ecoinformatics.org") or ("resource" in kind.lower() and "map" in kind.lower()) or name.endswith((".xml", ".rdf"))
        members.append({"identifier": tag("identifier"), "format_id": kind, "file_name": name, "size_bytes": int(size) if size.isdigit() else 0, "is_metadata": about})
        if not about:
            files.append(Remote(f"{DATAONE}resolve/{quote(d, safe='')}", safe_name(name or f"{tag('identifier')}.bin"), kind, int(size) if size.isdigit() else 0, note=name))
    return Found({"ess_dive_package": {"doi": doi, "package": docs[0], "members": members}}, files, [f"{len(files)} members are listed for {doi}."])


def mendeley(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """Files of a dataset's version; of the dataset where the version lists none."""
    m = re.search(r"/datasets/([^/?#]+)(?:/(\d+))?", s["landing_url"])
    if not m:
        raise ValueError(f"no dataset in {s['landing_url']}")
    base, notes = MENDELEY + m[1], []

    def listed(d: dict) -> list[Remote]:
        rows = [(f.get("filename"), f.get("content_details") or {}) for f in d.get("files") or [] if isinstance(f, dict)]
        return [Remote(str(c["download_url"]), safe_name(str(n)), str(c.get("content_type") or ""), int(c.get("size") or 0), str(c.get("sha256_hash") or ""), str(n)) for n, c in rows if n and c.get("download_url")]

    data = http.get(f"{base}?version={int(m[2])}" if m[2] else base).json()
    files = listed(data)
    if m[2] and not files and (other := listed(whole := http.get(base).json())):
        data, files = whole, other
        notes.append("The version listed no files; the dataset's were taken.")
    return Found({"mendeley_dataset": {"dataset_id": m[1], "requested_version": int(m[2]) if m[2] else None, "dataset": data}}, files, [*notes, f"{len(files)} files are listed."])


def neon(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """Spectra tables of every site and month of a product."""
    code = [p for p in urlsplit(s["landing_url"]).path.split("/") if p]
    if not code:
        raise ValueError(f"no product in {s['landing_url']}")
    product = http.get(NEON + code[-1]).json()
    files, sites = [], []
    for site in (product.get("data") or {}).get("siteCodes", []):
        months = []
        for url in site.get("availableDataUrls") or []:
            d = http.get(str(url)).json().get("data") or {}
            months.append(str(d.get("month", "")))
            for f in d.get("files") or []:
                n = str(f.get("name", ""))
                if f.get("url") and n.startswith("FSP_") and n.endswith(".csv"):
                    size = str(f.get("size", ""))
                    files.append(Remote(str(f["url"]), safe_name(n), "text/csv", int(size) if size.isdigit() else 0, note=f"{site.get('siteCode', '')} {months[-1]} {n}".strip()))
        sites.append({"site_code": str(site.get("siteCode", "")), "months": sorted(set(filter(None, months)))})
    return Found({"neon_product": {"product_code": code[-1], "product": product}, "neon_catalog": {"site_count": len(sites), "spectra_file_count": len(files), "sites": sites}}, files, [f"{len(files)} files at {len(sites)} sites are listed."])


def pangaea(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """The archive that the landing page, or the page of its DOI, links to."""
    links = lambda r: [urljoin(r.url, h) for h in re.findall(r"""href=["']([^"']+)["']""", r.text(), re.I)]
    file_in = lambda ls, doi: next((m[0] for u in ls if (m := re.search(PANGAEA_FILE, u, re.I))), "") or next((u for u in ls if doi and u.startswith(doi) and "format=zip" in u), "")
    page = links(http.get(s["landing_url"]))
    doi = next((m[0].replace("https://doi.org/", "https://doi.pangaea.de/") for u in page if (m := re.search(PANGAEA_DOI, u, re.I))), "")
    url = file_in(page, doi)
    if doi and not url:
        r = http.get(doi)
        url = file_in(links(r), r.url)
    name = name_of(url, f"{s['source_id']}.zip") if url else ""
    files = [Remote(url, name if name.lower().endswith(".zip") or "format=zip" not in url else f"{s['source_id']}.zip", "application/zip")] if url else []
    return Found({"pangaea_record": {"doi_url": doi, "download_url": url, "links": page[:25]}}, files, [] if files else ["No download is linked."])


def github_archive(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """Files of an archive under the prefix after # in its address, without its top folder."""
    url, _, prefix = (s["download_url"] or s["landing_url"]).partition("#")
    prefix = prefix.strip("/")
    out = Found({"github_archive": {"archive_url": url, "extract_prefix": prefix}})
    if assets:
        with zipfile.ZipFile(io.BytesIO(http.get(url).body)) as z:
            for n in sorted(z.namelist()):
                inner = n.split("/", 1)[1] if "/" in n else n
                if n.endswith("/") or ".." in inner.split("/") or not inner.startswith(prefix + "/" if prefix else ""):
                    continue
                rest = inner[len(prefix) :].lstrip("/")
                out.files.append(Remote(f"{url}#{prefix}" if prefix else url, rest, body=z.read(n), part="data", note=rest))
        out.status = "downloaded"
    return out


def by_hand(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    keys = ("source_id", "landing_url", "download_url", "auth_mode", "expected_format", "notes")
    return Found({"manual_review": {k: s.get(k, "") for k in keys}}, notes=["The source must be resolved by hand."], status="manual_review")


def specchio(s: Mapping[str, str], http: Http, assets: bool) -> Found:
    """Spectra that a client gives for query conditions. http.client: an object with spaces(conditions), each of them
    (wavelengths, unit, [(id, values), ...]); without one the source is left for review."""
    client, conditions = getattr(http, "client", None), getattr(http, "conditions", [])
    about = {"source_id": s["source_id"], "landing_url": s["landing_url"], "query_conditions": conditions}
    if any(not {"attribute", "operator", "value"} <= set(c) for c in conditions):
        raise ValueError("a query condition needs attribute, operator and value")
    if client is None or (assets and not conditions):
        return Found({"specchio_runtime": about}, notes=["A client and query conditions are needed."], status="manual_review")
    files = []
    for k, (axis, unit, rows) in enumerate(client.spaces(conditions) if conditions else [], 1):
        lines = [["spectrum_id", "measurement_unit", *axis], *[[i, unit, *v] for i, v in rows]]
        body = "\n".join(",".join(map(str, r)) for r in lines) + "\n"
        files.append(Remote("", f"space_{k:03d}.csv", "text/csv", body=body.encode(), note=f"{len(rows)} spectra"))
    return Found({"specchio_runtime": about}, files)


ADAPTERS: dict[str, Adapter] = {
    "static_http": static_http, "zenodo_api": zenodo, "ecosis_package": ecosis, "ecostress_web": ecostress, "ess_dive_dataone": ess_dive, "mendeley_public": mendeley, "neon_api": neon, "pangaea": pangaea,
    "github_archive": github_archive, "specchio_client": specchio, "manual_portal": by_hand, "earthdata_lpdaac": by_hand,
}


@dataclass
class Artifact:
    artifact_id: str
    kind: str
    url: str
    path: str
    media_type: str
    size_bytes: int
    sha256: str
    status: str
    note: str = ""


def _put(folder: str, name: str, body: bytes) -> str:
    fs, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(body)
    return f"{folder}/{name}"


def bucket(name: str) -> str:
    """metadata, docs or data, by the name of a file."""
    suffix = os.path.splitext(name)[1].lower()
    return "metadata" if suffix in RECORDS.split() else "docs" if suffix in DOCS.split() or re.search("readme|license", name, re.I) else "data"


def fetch(source: Mapping[str, str], root: str, assets: bool = False, http: Http | None = None, tidy: bool = True) -> dict[str, object]:
    """Fetch one source into root/source_id and write fetch-result.json there; the result. root: a URI.

    tidy: files go into metadata, docs and data. An adapter that is not known is an error, as is one that fails.
    """
    s = {k: "" if v is None else str(v) for k, v in source.items()}
    for k in ("download_url", "landing_url", "name"):
        s.setdefault(k, "")
    http, folder, begun = http or Http(), f"{root.rstrip('/')}/{s['source_id']}", now()
    if s["fetch_adapter"] not in ADAPTERS:
        raise CodedError(DOWNLOAD, "unknown fetch adapter", fetch_adapter=s["fetch_adapter"], known=sorted(ADAPTERS))
    found = ADAPTERS[s["fetch_adapter"]](s, http, assets)
    made: list[Artifact] = []

    def keep(name: str, body: bytes, kind: str, url: str, media: str, status: str, note: str = "", part: str = "") -> None:
        place = f"{part or (bucket(name) if tidy else '')}/{name}".lstrip("/")
        path = _put(folder, place, body)
        made.append(Artifact(os.path.splitext(os.path.basename(name))[0], kind, url, path, media, len(body), hashlib.sha256(body).hexdigest(), status, note))

    for name, doc in found.documents.items():
        keep(f"{name}.json", (json.dumps(doc, indent=2, sort_keys=True) + "\n").encode(), "metadata", "", "application/json", "written")
    got = 0
    for k, f in enumerate(found.files, 1):
        if assets and f.wanted:
            reply = None if f.body is not None else http.get(f.url)
            keep(f.name, f.body if reply is None else reply.body, "data", f.url, f.media_type if reply is None else reply.media_type, "downloaded", f.note, f.part)
            got += 1
        else:
            made.append(Artifact(f"remote_file_{k}", "remote_file", f.url, "", f.media_type, f.size, f.sha256, "discovered", f.note or f.name))
    if not assets and not found.status:
        found.notes.append("Metadata were taken, no files.")
    status = found.status or ("downloaded" if got else "metadata_only")
    mode = "metadata" if found.status == "manual_review" and not found.files else "assets" if assets else "metadata"
    return _result(s, folder, mode, status, begun, found.notes, made)


def _result(s: Mapping[str, str], folder: str, mode: str, status: str, begun: str, notes: Sequence[str], made: Sequence[Artifact]) -> dict[str, object]:
    out = {"source_id": s["source_id"], "source_name": s["name"], "fetch_adapter": s["fetch_adapter"], "fetch_mode": mode, "status": status, "landing_url": s["landing_url"], "started_at": begun, "finished_at": now(), "notes": list(notes), "artifacts": [asdict(a) for a in made]}
    _put(folder, "fetch-result.json", (json.dumps(out, indent=2, sort_keys=True) + "\n").encode())
    return out


def fetch_all(spark: SparkSession, manifest: DataFrame, root: str, assets: bool = False, http: Http | None = None, keep_on: bool = True, tasks: int = 8) -> DataFrame:
    """Fetch every source of the manifest, in `tasks` tasks: source_id, status, fetch_adapter, n_artifacts, error.

    keep_on: a failing source leaves a result of status error. The rows are computed once and written to root/batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for s in d.to_dict("records"):
                why = None
                try:
                    r = fetch(s, root, assets, http)
                except Exception as e:
                    if not keep_on:
                        raise
                    why, own = f"{type(e).__name__}: {e}", {k: str(v or "") for k, v in s.items()}
                    r = _result({"name": "", "landing_url": "", **own}, f"{root.rstrip('/')}/{s['source_id']}", "assets" if assets else "metadata", "error", now(), [why], [])
                yield pd.DataFrame([(s["source_id"], r["status"], s["fetch_adapter"], len(r["artifacts"]), why)], columns=["source_id", "status", "fetch_adapter", "n_artifacts", "error"])

    rows = manifest.repartition(tasks, "source_id").mapInPandas(run, "source_id string, status string, fetch_adapter string, n_artifacts int, error string")
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch")
    return spark.read.parquet(f"{root.rstrip('/')}/batch")


def tidied(folder: str) -> dict[str, int]:
    """Move loose files of a fetched source into metadata, docs and data, and follow them in its fetch-result.json."""
    fs, base = pafs.FileSystem.from_uri(folder)
    counts = {"metadata": 0, "docs": 0, "data": 0}
    for f in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
        if f.type == pafs.FileType.File and f.base_name != "fetch-result.json" and not f.base_name.startswith("."):
            place = f"{base}/{bucket(f.base_name)}"
            fs.create_dir(place, recursive=True)
            fs.move(f.path, f"{place}/{f.base_name}")
    places = {}
    for kind in counts:
        held = [f for f in fs.get_file_info(pafs.FileSelector(f"{base}/{kind}", allow_not_found=True, recursive=True)) if f.type == pafs.FileType.File]
        counts[kind] = len(held)
        places |= {f.base_name: f.path for f in held}
    if fs.get_file_info(f"{base}/fetch-result.json").type == pafs.FileType.File:
        with fs.open_input_stream(f"{base}/fetch-result.json") as stream:
            result = json.loads(stream.read())
        for a in result.get("artifacts", []):
            if a.get("path") and (now_at := places.get(os.path.basename(a["path"]))):
                a["path"] = now_at
        _put(folder, "fetch-result.json", (json.dumps(result, indent=2, sort_keys=True) + "\n").encode())
    return counts


def matrix(manifest: DataFrame, limit: int | None = None, order: str = "source_id", **wanted: Sequence[str]) -> dict[str, object]:
    """Selected sources with what a job needs of each, and a digest of the whole manifest."""
    from ..operators.curation import selected

    keys = ["source_id", "fetch_adapter", "tier", "status", "auth_mode", "expected_format"]
    rows = selected(manifest, limit, order, **wanted).orderBy(order)
    text = "\n".join(json.dumps(r.asDict(), sort_keys=True) for r in manifest.orderBy("source_id").toLocalIterator())
    return {"include": [r.asDict() for r in rows.select(*keys).collect()], "manifest_sha256": hashlib.sha256(text.encode()).hexdigest()}
