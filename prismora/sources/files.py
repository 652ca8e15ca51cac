"""Small files and folders of any store that Spark reaches, through Hadoop's file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import MISSING, CodedError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the place, then move there."""
    fs, p = _fs(spark, path)
    temp = p.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    fs.rename(temp, p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise CodedError(MISSING, "the file is missing", path=path)
    rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    return bytes(rows[0][0]).decode() if rows else ""


def move_into_place(spark: SparkSession, temp: str, path: str) -> None:
    """Put a whole folder or file in the place of another; if the move fails, what was there comes back."""
    fs, new = _fs(spark, temp)
    _, place = _fs(spark, path)
    old = place.suffix(f".{uuid.uuid4().hex}.old")
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise CodedError("prepare_failed", "the old folder can't be moved", path=path)
    try:
        done = fs.rename(new, place)
    except Exception:
        done = False
    if not done:
        if had:
            fs.rename(old, place)
        raise CodedError("prepare_failed", "the new folder can't be moved into place", path=path)
    if had:
        fs.delete(old, True)
