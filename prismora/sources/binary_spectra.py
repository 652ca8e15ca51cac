"""Spectra in binary files: image-style libraries with a header, spreadsheets, serialised data frames, classic netCDF."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import math
import re
import struct
import zipfile
from xml.etree import ElementTree

import numpy as np

from .text_spectra import Rows, Spectrum, auxiliary, axis_name, bare, decoded, nanometres, number, row_wide, stem_of, wavelength

# Number formats and names.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
NETCDF_NAMES = ("reflectance", "rrs", "rw", "refl")
MEAN_NAMES = ("mean", "reflectance", "value")
PREVIEW = 80


# libraries with a text header


def envi_header(content: bytes) -> dict[str, str | list[str]]:
    """key = value entries; a value in braces may run over lines and is a list."""
    out: dict[str, str | list[str]] = {}
    key, held = None, ""
    for line in decoded(content).splitlines():
        s = line.strip()
        if not s or s.upper() == "ENVI" or (key is None and "=" not in s):
            continue
        if key is None:
            key, _, held = (p.strip() for p in s.partition("="))
            key = key.lower()
        else:
            held += " " + s
        if held.count("{") <= held.count("}"):
            out[key], key = _braced(held), None
    if key is not None:
        out[key] = _braced(held)
    return out


def _braced(value: str) -> str | list[str]:
    v = value.strip()
    if v.startswith("{") and v.endswith("}"):
        return [x.strip() for x in v[1:-1].split(",")] if v[1:-1].strip() else []
    return v


def _listed(header: dict, key: str) -> list[str]:
    v = header.get(key, [])
    return [str(x).strip() for x in (v if isinstance(v, list) else [v]) if str(x).strip()]


def envi_companions(path: str, header: dict) -> list[str]:
    """Where the data of a header may be, best first."""
    stem = re.sub(r"\.hdr$", "", path, flags=re.I)
    named = str(header.get("data file", "")).strip()
    return [stem, f"{stem}.sli", f"{stem}.img", *([f"{path.rsplit('/', 1)[0]}/{named}"] if named else [])]


def envi(header: dict, data: bytes, path: str, data_path: str) -> list[Spectrum]:
    w = [v for x in _listed(header, "wavelength") if (v := number(x)) is not None]
    if not w:
        raise ValueError("ENVI header is missing wavelength values")
    whole = lambda k: int(float(str(header.get(k, "0")) or 0))
    kind, order = str(header.get("file type", "")).lower(), str(header.get("interleave", "")).lower()
    if "spectral library" in kind:
        shape = whole("lines"), whole("samples")
    elif order == "bip" and whole("samples") == 1:
        shape = whole("lines"), whole("bands")
    elif order == "bsq" and whole("bands") == 1:
        shape = whole("lines"), whole("samples")
    else:
        raise ValueError(f"unsupported ENVI layout: file_type={kind or 'unknown'} interleave={order or 'unknown'}")
    code = whole("data type")
    if code not in ENVI_TYPES:
        raise ValueError(f"unsupported ENVI data type: {code}")
    dtype = np.dtype((">" if str(header.get("byte order", "0")).strip() == "1" else "<") + ENVI_TYPES[code])
    if len(data) != shape[0] * shape[1] * dtype.itemsize:
        raise ValueError(f"ENVI binary length mismatch: expected {shape[0] * shape[1]} values, found {len(data) // dtype.itemsize}")
    values = np.frombuffer(data, dtype).reshape(shape).astype(float)
    names, hint = _listed(header, "spectra names"), number(str(header.get("reflectance scale factor", "")))
    w = nanometres(w, str(header.get("wavelength units", "")))
    meta = {"header_path": path, "data_path": data_path, "file_type": str(header.get("file type", "")), "interleave": str(header.get("interleave", ""))}
    return [Spectrum("envi_binary", names[k] if k < len(names) else f"spectrum_{k + 1:05d}", w, row.tolist(), dict(meta), hint) for k, row in enumerate(values)]


# spreadsheets


def sheets(content: bytes) -> list[tuple[str, list[list[object]]]]:
    """(name, rows of cells) of every sheet, from the file's own XML; dates stay numbers."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(e) == "sheet"):
            link = next(v for k, v in s.attrib.items() if k.rsplit("}", 1)[-1] == "id")
            target = links[link].lstrip("/")
            rows: list[list[object]] = []
            for r in (e for e in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if tag(e) == "row"):
                at = int(r.get("r", len(rows) + 1)) - 1
                rows += [[] for _ in range(at + 1 - len(rows))]
                for c in (e for e in r if tag(e) == "c"):
                    col = _column(c.get("r")) if c.get("r") else len(rows[at])
                    rows[at] += [None] * (col + 1 - len(rows[at]))
                    rows[at][col] = _cell(c, shared, tag)
            out.append((s.get("name", ""), rows))
        return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(c: ElementTree.Element, shared: list[str], tag) -> object:
    kind, text = c.get("t", "n"), next((e.text for e in c if tag(e) == "v"), None)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter() if tag(t) == "t")
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)]
    if kind != "n":
        return text
    v = float(text)
    return int(v) if v.is_integer() else v


def spreadsheet(content: bytes, source: str, path: str) -> list[Spectrum]:
    """Each sheet by the first of its layouts: band column with reflectance columns, mean curve, one spectrum a row."""
    out = []
    for name, rows in sheets(content):
        low = [[bare(c).lower() for c in r] for r in rows[:PREVIEW]]
        found: list[Spectrum] = []
        at = next((i for i, r in enumerate(low) if r.count("reflectance") >= 3 and "band" in r), None)
        mean = next((i for i, r in enumerate(low) if len(r) >= 2 and r[0] == "wavelength" and r[1] in MEAN_NAMES and sum(len(p) > 1 and number(p[0]) is not None and number(p[1]) is not None for p in rows[i + 1 : i + 6]) >= 3), None)
        wide = next((i for i, r in enumerate(rows[:PREVIEW]) if sum(wavelength(c) is not None for c in r) >= 3), None)
        if at is not None:
            found = _band_matrix(name, rows, low, at)
        elif mean is not None:
            points = [p for r in rows[mean + 1 :] if len(r) > 1 and (p := (number(r[0]), number(r[1]))) and None not in p]
            if len(points) >= 2:
                w, v = map(list, zip(*points))
                found = [Spectrum("xlsx_sheet_mean_curve", name, w, v, {"sheet": name})]
        elif wide is not None:
            found = row_wide(rows[wide], rows[wide + 1 :], source, path, "xlsx_row_wide")
        for s in found:
            s.part = name
        out += found
    return out


def _band_matrix(name: str, rows: Rows, low: list[list[str]], at: int) -> list[Spectrum]:
    """Spectra in the columns right of the band column; the rows above the header describe them."""
    cell = lambda r, i: r[i] if i < len(r) else None
    band = low[at].index("band")
    out = []
    for i in range(band + 1, len(rows[at])):
        if auxiliary(rows[at][i]) or not any(bare(cell(r, i)) for r in rows[at + 1 : at + 6]):
            continue
        meta = {"sheet": name} | {bare(r[0]).lower(): bare(cell(r, i)) for r in rows[:at] if r and bare(r[0]) and bare(cell(r, i))}
        points = [(w, math.nan if (v := number(cell(r, i))) is None else v) for r in rows[at + 1 :] if (w := number(cell(r, band))) is not None]
        day = meta.get("julian day")
        label = (meta.get("plot id") or f"{name}_{i + 1:03d}") + (f"_jd{day}" if day else "")
        out.append(Spectrum("xlsx_band_matrix", label, [w for w, _ in points], [v for _, v in points], meta))
    return out


# serialised data frames


class _Rds:
    """Reader of R's XDR serialisation: vectors, lists, strings and attributes; nothing is evaluated."""

    def __init__(self, body: bytes):
        self.body, self.at, self.refs = body, 0, []
        if body[:2] != b"X\n":
            raise ValueError("only binary XDR files are read")
        self.at = 2
        version, _, _ = (self._int() for _ in range(3))
        if version == 3:
            self._take(self._int())

    def _take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.body):
            raise ValueError("the file ends early")
        return self.body[self.at - n : self.at]

    def _int(self) -> int:
        return struct.unpack(">i", self._take(4))[0]

    def _length(self) -> int:
        n = self._int()
        return n if n >= 0 else (self._int() << 32) + (self._int() & 0xFFFFFFFF)

    def value(self) -> tuple[object, dict]:
        """(value, attributes)."""
        mark = self._int()
        kind, has_attributes, has_tag = mark & 255, mark >> 9 & 1, mark >> 10 & 1
        if kind in (254, 242, 241, 253, 252, 251, 250):  # nothing, and the environments that have names
            return None, {}
        if kind == 255:
            return self.refs[(mark >> 8 or self._int()) - 1], {}
        if kind == 1:
            self.refs.append(self.value()[0])
            return self.refs[-1], {}
        if kind == 9:
            n = self._int()
            return (None if n == -1 else self._take(n).decode("utf-8", "replace")), {}
        if kind == 2:
            return self._pairs(has_attributes, has_tag), {}
        if kind == 238:
            return self._compact()
        if kind in (13, 10):
            raw = np.frombuffer(self._take(4 * (n := self._length())), ">i4").astype(float)
            out: object = np.where(raw == -(2**31), np.nan, raw)
        elif kind == 14:
            out = np.frombuffer(self._take(8 * self._length()), ">f8").astype(float)
        elif kind == 16:
            out = [self.value()[0] for _ in range(self._length())]
        elif kind in (19, 20):
            out = [self.value() for _ in range(self._length())]
        elif kind == 24:
            out = self._take(self._length())
        else:
            raise ValueError(f"unsupported RDS value of type {kind}")
        return out, dict(self.value()[0] or []) if has_attributes else {}

    def _pairs(self, has_attributes: int, has_tag: int) -> list[tuple[str, object]]:
        if has_attributes:
            self.value()
        name = self.value()[0] if has_tag else ""
        item = self.value()
        rest = self.value()[0]
        return [(name, item), *(rest or [])]

    def _compact(self) -> tuple[object, dict]:
        """Sequences that are stored by their ends, and wrapped vectors."""
        info, state, attributes = self.value()[0], self.value(), self.value()[0]
        name = info[0][1][0] if info else ""
        if name in ("compact_intseq", "compact_realseq"):
            n, first, step = state[0]
            return first + step * np.arange(int(n)), dict(attributes or [])
        if str(name).startswith("wrap_"):
            inner = state[0][0] if isinstance(state[0], list) else state
            inner = inner[1] if isinstance(inner, tuple) and len(inner) == 2 and isinstance(inner[0], str) else inner
            return inner
        raise ValueError(f"unsupported RDS value {name}")


def _plain(content: bytes) -> bytes:
    for magic, opened in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ", lzma.decompress)):
        if content.startswith(magic):
            return opened(content)
    return content


def _frame(value: tuple[object, dict]) -> tuple[list[str], list[list[object]]] | None:
    """(column names, rows) of a data frame."""
    cols, attributes = value
    kinds = attributes.get("class", ([], {}))[0] or []
    if not isinstance(cols, list) or "data.frame" not in kinds:
        return None
    names = list(attributes.get("names", ([], {}))[0] or [])
    lists = []
    for c, a in cols:
        levels = a.get("levels", (None, {}))[0]
        values = list(c) if c is not None else []
        lists.append([None if v != v else levels[int(v) - 1] for v in values] if levels else [None if isinstance(v, float) and v != v else v for v in values])
    return names, [list(r) for r in zip(*lists)]


def data_frame(content: bytes, source: str, path: str) -> list[Spectrum]:
    """Spectra of a serialised data frame, one a row, or of the first one in a list."""
    value = _Rds(_plain(content)).value()
    found, part = _frame(value), ""
    if found is None and isinstance(value[0], list):
        names = list(value[1].get("names", ([], {}))[0] or [])
        for k, item in enumerate(value[0]):
            if isinstance(item, tuple) and (found := _frame(item)) is not None:
                part = names[k] if k < len(names) else str(k)
                break
    if found is None:
        raise ValueError("unsupported RDS payload: no data frame")
    out = row_wide(found[0], found[1], source, path, "rds_dataframe")
    for s in out:
        s.part = part
    return out


# netCDF


class _Classic:
    """Header and variables of classic netCDF (CDF-1 and CDF-2)."""

    TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}

    def __init__(self, body: bytes):
        self.body, self.at = body, 4
        self.wide = body[3] == 2
        self.records = self._int()
        self.dimensions = [(self._name(), self._int()) for _ in range(self._list(10))]
        self.attributes = self._attributes()
        self.variables: dict[str, tuple[list[int], dict, int, int]] = {}
        for _ in range(self._list(11)):
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            about, kind, size = self._attributes(), self._int(), self._int()
            begin = struct.unpack(">q", self._take(8))[0] if self.wide else self._int()
            self.variables[name] = (dims, about, kind, begin)
            del size

    def _take(self, n: int) -> bytes:
        self.at += n
        return self.body[self.at - n : self.at]

    def _int(self) -> int:
        return struct.unpack(">i", self._take(4))[0]

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError("the netCDF header is damaged")
        return n

    def _name(self) -> str:
        n = self._int()
        return self._take(n + -n % 4)[:n].decode("utf-8", "replace")

    def _attributes(self) -> dict[str, object]:
        out = {}
        for _ in range(self._list(12)):
            name, kind, n = self._name(), self._int(), self._int()
            dtype = np.dtype(self.TYPES[kind])
            raw = self._take(n * dtype.itemsize + -(n * dtype.itemsize) % 4)[: n * dtype.itemsize]
            out[name] = raw.decode("utf-8", "replace").rstrip("\x00") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out

    def names_of(self, name: str) -> list[str]:
        return [self.dimensions[d][0] for d in self.variables[name][0]]

    def units(self, name: str) -> str:
        return str(self.variables[name][1].get("units", ""))

    def array(self, name: str) -> np.ndarray:
        dims, about, kind, begin = self.variables[name]
        dtype = np.dtype(self.TYPES[kind])
        shape = [self.dimensions[d][1] for d in dims]
        if dims and shape[0] == 0:  # records of all variables that have them lie interleaved
            own = int(np.prod(shape[1:], dtype=int)) * dtype.itemsize
            sizes = [int(np.prod([self.dimensions[d][1] for d in v[0][1:]], dtype=int)) * np.dtype(self.TYPES[v[2]]).itemsize for v in self.variables.values() if v[0] and self.dimensions[v[0][0]][1] == 0]
            step = sum(s + -s % 4 for s in sizes) if len(sizes) > 1 else own
            raw = b"".join(self.body[begin + k * step : begin + k * step + own] for k in range(self.records))
            shape[0] = self.records
        else:
            raw = self.body[begin : begin + int(np.prod(shape, dtype=int)) * dtype.itemsize]
        out = np.frombuffer(raw, dtype).reshape(shape).astype(float)
        for key in ("_FillValue", "missing_value"):
            for fill in about.get(key, []) if isinstance(about.get(key), list) else []:
                out[out == fill] = np.nan
        return out


def netcdf(content: bytes, path: str) -> list[Spectrum]:
    """Reflectance over wavelength, one spectrum or one an observation. Classic files; HDF5 ones are not read."""
    if content[:3] != b"CDF" or content[3] not in (1, 2):
        raise ValueError("only classic netCDF files are read")
    d = _Classic(content)
    axis = next((n for n in d.variables if axis_name(n)), None)
    if axis is None:
        raise ValueError("netCDF file is missing a wavelength variable")
    over = [n for n in d.variables if "wavelength" in d.names_of(n)]
    name = next((n for n in over if bare(n).lower() in NETCDF_NAMES), None) or next((n for n in over if "reflectance" in n.lower() and not auxiliary(n)), None)
    if name is None:
        raise ValueError("netCDF file is missing a reflectance variable")
    w = nanometres(d.array(axis).tolist(), d.units(axis))
    sizes = {n: (k or d.records) for n, k in d.dimensions}
    meta = {"value_variable": name, "wavelength_variable": axis, "netcdf_dimensions": json.dumps(sizes, sort_keys=True)} | {f"attr:{k}": str(v).strip() for k, v in d.attributes.items()}
    values, dims, stem = d.array(name), d.names_of(name), stem_of(path)
    if values.ndim == 1:
        return [Spectrum("netcdf_reflectance", stem, w, values.tolist(), meta)]
    if values.ndim == 2 and dims[-1] == axis:
        return [Spectrum("netcdf_reflectance", f"{stem}_{k + 1:05d}", w, row.tolist(), meta | {"obs_index": str(k)}) for k, row in enumerate(values)]
    raise ValueError(f"unsupported netCDF reflectance dimensions {tuple(dims)!r}")
