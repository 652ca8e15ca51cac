"""The prepared library: spectra on the grid, the features of every sensor and segment, sensors and a manifest.

In memory a Prepared holds DataFrames; on disk it is a folder of Parquet tables (library, features by sensor and
segment), sensors.json and manifest.json with a SHA-256 of every file. A build is written beside its place and moved
there when it is whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import INPUT, LIBRARY, PREPARE, VERSION, CodedError
from ..grid import CANONICAL, SEGMENTS, Grid
from ..operators.arrays import projected
from ..operators.indexing import row_id
from ..sources.files import exists, move_into_place, read_text, write_text
from ..sources.sensors import Sensor, sensor_of

SCHEMA_VERSION = "1.0"


@dataclass
class Prepared:
    """library: row_index, row_id, source_id, spectrum_id, sample_name, name_code, vnir, swir and further metadata."""

    grid: Grid
    sensors: dict[str, Sensor]
    library: DataFrame
    path: str | None = None

    @functools.cached_property
    def rows(self) -> int:
        """Rows of the library, counted once."""
        return self.library.select("row_index").count()

    def sensor(self, sensor_id: str) -> Sensor:
        if sensor_id not in self.sensors:
            raise CodedError(INPUT, "the sensor is not in the prepared library", sensor_id=sensor_id, known=sorted(self.sensors))
        return self.sensors[sensor_id]

    def features(self, sensor_id: str, segment: str) -> DataFrame:
        """row_index, name_code, x: the simulated bands that the segment is searched by."""
        sensor = self.sensor(sensor_id)
        if self.path and exists(self.library.sparkSession, f"{self.path}/features/sensor_id={sensor_id}/segment={segment}"):
            return self.library.sparkSession.read.parquet(f"{self.path}/features/sensor_id={sensor_id}/segment={segment}")
        return self.simulated(sensor, sensor.searched(segment)).select("row_index", "name_code", "x")

    def simulated(self, sensor: Sensor, places: Iterable[int] | None = None) -> DataFrame:
        """row_index, name_code, x: band values of every library row, each band from its own segment."""
        places = list(range(len(sensor.bands)) if places is None else places)
        whole = sensor.weights(self.grid, places)
        sides = [[k for k, p in enumerate(places) if sensor.bands[p].segment == s] for s in SEGMENTS]
        rows = self.library.select("row_index", "name_code", *SEGMENTS)
        for s, own in zip(SEGMENTS, sides):
            rows = projected(rows, s, whole[self.grid.part(s)][:, own], f"x_{s}") if own else rows.withColumn(f"x_{s}", F.array().cast("array<double>"))
        order = [F.get(f"x_{s}", F.lit(own.index(k))) for k in range(len(places)) for s, own in zip(SEGMENTS, sides) if k in own]
        return rows.select("row_index", "name_code", F.array(*order).cast("array<double>").alias("x"))

    def spectra(self, segment: str) -> DataFrame:
        """row_index, y: the segment's spectra."""
        return self.library.select("row_index", F.col(segment).cast("array<double>").alias("y"))

    def projection(self, target: Sensor, segment: str) -> DataFrame | None:
        """row_index, y: the target's bands of the segment, simulated once a library row, so that a query combines
        band values and not spectra; combining is linear, so both give the same."""
        own = target.own(segment)
        return self.simulated(target, own).select("row_index", F.col("x").alias("y")) if own else None


def prepared(library: DataFrame, sensors: Iterable[Sensor] | Mapping[str, Sensor], grid: Grid = CANONICAL, values: str = "values") -> Prepared:
    """A library in memory from rows with row_index, source_id, spectrum_id, sample_name and an array on the grid.

    name_code numbers the sample names: the least row_index that has the name.
    """
    given = sensors.values() if isinstance(sensors, Mapping) else sensors
    v, s = grid.part("vnir"), grid.part("swir")
    rows = library.withColumn("vnir", F.slice(values, v.start + 1, v.stop - v.start)).withColumn("swir", F.slice(values, s.start + 1, s.stop - s.start)).drop(values)
    names = rows.groupBy("sample_name").agg(F.min("row_index").alias("name_code"))
    rows = rows.withColumn("row_id", row_id()).join(names, "sample_name", "left")
    return Prepared(grid, {x.sensor_id: sensor_of(x, grid) for x in given}, rows)


def build(spark: SparkSession, library: DataFrame, sensors: Iterable[Sensor], path: str, grid: Grid = CANONICAL, dtype: str = "float32", about: Mapping[str, object] | None = None) -> Prepared:
    """Write a prepared library to `path` and open it; what was there is replaced when all is written.

    library: rows as `prepared` takes them, arrays without nulls. dtype: float32 or float64, of what is stored.
    """
    if dtype not in ("float32", "float64"):
        raise CodedError(PREPARE, "dtype must be float32 or float64", dtype=dtype)
    sensors = list(sensors)
    if not sensors:
        raise CodedError(PREPARE, "a source sensor must be given")
    made = prepared(library, sensors, grid)
    kind = "float" if dtype == "float32" else "double"
    temp = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows = made.library
    for s in SEGMENTS:
        rows = rows.withColumn(s, F.col(s).cast(f"array<{kind}>"))
    rows.write.parquet(f"{temp}/library")
    stored = Prepared(grid, made.sensors, spark.read.parquet(f"{temp}/library"))
    for sensor in sensors:
        for s in SEGMENTS:
            x = stored.features(sensor.sensor_id, s).withColumn("x", F.col("x").cast(f"array<{kind}>"))
            x.write.parquet(f"{temp}/features/sensor_id={sensor.sensor_id}/segment={s}")
    write_text(spark, f"{temp}/sensors.json", json.dumps({"schema_version": SCHEMA_VERSION, "grid": grid.as_dict(), "sensors": [x.as_dict() for x in sensors]}, sort_keys=True))
    count = stored.library.count()
    if not count:
        raise CodedError(PREPARE, "the library has no rows")
    manifest = {"schema_version": SCHEMA_VERSION, "row_count": count, "dtype": dtype, "grid": grid.as_dict(), "source_sensors": [x.sensor_id for x in sensors], "checksums": checksums(spark, temp), "about": dict(about or {})}
    write_text(spark, f"{temp}/manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
    move_into_place(spark, temp, path)
    return opened(spark, path)


def build_once(spark: SparkSession, library: DataFrame, sensors: Iterable[Sensor], root: str, grid: Grid = CANONICAL, dtype: str = "float32") -> Prepared:
    """A build in the folder of `root` that is named by a digest of rows, sensors, grid and dtype; one that is there is opened."""
    sensors = list(sensors)
    row = F.xxhash64(*sorted(library.columns))
    whole = library.agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    about = json.dumps([*map(str, whole), [s.as_dict() for s in sensors], str(grid), dtype], sort_keys=True)
    path = f"{root.rstrip('/')}/{hashlib.sha256(about.encode()).hexdigest()[:24]}"
    return opened(spark, path) if exists(spark, f"{path}/manifest.json") else build(spark, library, sensors, path, grid, dtype)


def checksums(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every data file under the path by its relative name; files are digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"/((?:library|features)/.*|sensors\.json)$", 1)
    return {r["name"]: r["sha"] for r in files.select(name.alias("name"), F.sha2("content", 256).alias("sha")).where("name <> ''").toLocalIterator()}


def opened(spark: SparkSession, path: str, check: bool = False) -> Prepared:
    """Open a prepared library; `check` runs validate()."""
    path = path.rstrip("/")
    try:
        manifest, given = json.loads(read_text(spark, f"{path}/manifest.json")), json.loads(read_text(spark, f"{path}/sensors.json"))
    except ValueError as e:
        raise CodedError(LIBRARY, "a file of the prepared library is not JSON", path=path) from e
    for part in (manifest, given):
        if part.get("schema_version") != SCHEMA_VERSION:
            raise CodedError(VERSION, "the prepared library has another schema version", found=part.get("schema_version"), wanted=SCHEMA_VERSION)
    if given.get("grid") != manifest.get("grid"):
        raise CodedError(LIBRARY, "sensors and manifest are on different grids", path=path)
    grid = Grid.from_dict(manifest["grid"])
    out = Prepared(grid, {x["sensor_id"]: sensor_of(x, grid) for x in given["sensors"]}, spark.read.parquet(f"{path}/library"), path)
    if check:
        validate(out, manifest)
    return out


def validate(p: Prepared, manifest: Mapping[str, object]) -> None:
    """Rows 0..n-1 once each, row ids once each, whole arrays of the right widths, features of every sensor, checksums."""
    lib, spark = p.library, p.library.sparkSession
    widths = [F.max(F.size(s)) for s in SEGMENTS] + [F.min(F.size(s)) for s in SEGMENTS]
    r = lib.agg(F.count("*"), F.countDistinct("row_index"), F.countDistinct("row_id"), F.min("row_index"), F.max("row_index"), *widths).first()
    n = manifest["row_count"]
    if (r[0], r[1], r[2], r[3], r[4]) != (n, n, n, 0, n - 1):
        raise CodedError(LIBRARY, "rows are not numbered 0 to n-1, or row ids are not unique", row_count=n, found=list(r[:5]))
    want = [p.grid.width_of(s) for s in SEGMENTS]
    if list(r[5:7]) != want or list(r[7:9]) != want:
        raise CodedError(LIBRARY, "spectra have the wrong width", wanted=want, found=list(r[5:9]))
    for name in manifest["source_sensors"]:
        for s in SEGMENTS:
            f = p.features(name, s).agg(F.count("*"), F.countDistinct("row_index"), F.min(F.size("x")), F.max(F.size("x"))).first()
            width = len(p.sensor(name).searched(s))
            if tuple(f) != (n, n, width, width):
                raise CodedError(LIBRARY, "features do not match the library", sensor_id=name, segment=s, found=list(f))
    if p.path and checksums(spark, p.path) != manifest["checksums"]:
        raise CodedError(LIBRARY, "a file's checksum differs from the manifest", path=p.path)
