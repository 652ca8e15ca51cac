"""Prepared libraries as one archive with a digest beside it, and their download."""

from __future__ import annotations

import hashlib
import io
import os
import tarfile
import tempfile
from urllib.request import urlopen

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from ..errors import DOWNLOAD, CodedError
from ..mapping.prepare import opened
from .files import exists

CHUNK = 1 << 20


def pack(root: str, target: str) -> str:
    """Write the folder as a tar.gz and its SHA-256 as <target>.sha256, file by file; the digest. Both are URIs."""
    fs, base = pafs.FileSystem.from_uri(root)
    out_fs, out = pafs.FileSystem.from_uri(target)
    digest = hashlib.sha256()

    class Out(io.RawIOBase):
        def writable(self) -> bool:
            return True

        def write(self, b) -> int:
            digest.update(b)
            stream.write(b)
            return len(b)

    with out_fs.open_output_stream(out, compression=None) as stream, tarfile.open(fileobj=Out(), mode="w|gz") as tar:
        for f in sorted(fs.get_file_info(pafs.FileSelector(base, recursive=True)), key=lambda f: f.path):
            if f.type == pafs.FileType.File:
                info = tarfile.TarInfo(os.path.relpath(f.path, base))
                info.size = f.size
                with fs.open_input_stream(f.path, compression=None) as body:
                    tar.addfile(info, body)
    with out_fs.open_output_stream(f"{out}.sha256", compression=None) as side:
        side.write(f"{digest.hexdigest()}  {os.path.basename(out)}\n".encode())
    return digest.hexdigest()


def download_library(spark: SparkSession, url: str, root: str, sha256: str | None = None, check: bool = True) -> str:
    """Download an archive, hold its digest against `sha256` (or <url>.sha256, where there is one), unpack it into the
    folder `root` and validate the library; root. Members that would leave the folder are refused."""
    if sha256 is None:
        try:
            with urlopen(f"{url}.sha256", timeout=60) as r:
                sha256 = (r.read().decode().split() or [None])[0]
        except OSError:
            sha256 = None
    fs, base = pafs.FileSystem.from_uri(root)
    digest = hashlib.sha256()
    with tempfile.TemporaryFile() as held:  # on the driver, until the digest is known
        with urlopen(url, timeout=300) as r:
            while part := r.read(CHUNK):
                digest.update(part)
                held.write(part)
        if sha256 and digest.hexdigest() != sha256:
            raise CodedError(DOWNLOAD, "the archive's SHA-256 differs", expected=sha256, found=digest.hexdigest())
        held.seek(0)
        with tarfile.open(fileobj=held, mode="r:gz") as tar:
            for member in tar:
                name = os.path.normpath(member.name)
                if name.startswith(("..", "/")):
                    raise CodedError(DOWNLOAD, "the archive reaches out of its folder", member=member.name)
                if member.isfile():
                    fs.create_dir(os.path.dirname(f"{base}/{name}"), recursive=True)
                    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                        body = tar.extractfile(member)
                        while part := body.read(CHUNK):
                            out.write(part)
    if not exists(spark, f"{root.rstrip('/')}/manifest.json"):
        raise CodedError(DOWNLOAD, "the archive has no manifest", root=root)
    opened(spark, root, check)
    return root
