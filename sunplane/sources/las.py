"""The `las` data source: LAS 1.0 to 1.4 files (LAZ ones through laspy, where it is installed) as rows (tile_id, x, y, z, cls), one partition for each
million points of a file, decoded in Arrow batches on the executors."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sunplane.sources.files import list_files, open_file

SCHEMA = "tile_id string, x double, y double, z double, cls smallint"
POINTS_PER_PARTITION, POINTS_PER_BATCH = 1_000_000, 100_000
#: Headers that the driver reads at once.
HEADERS_AT_ONCE = 32


class CompressedPoints(ValueError):
    """The file's points are LAZ-compressed, and laspy with a LAZ backend isn't installed or not wanted."""


class WrongReference(ValueError):
    """The file's reference system isn't the one that is asked for."""


@dataclass(frozen=True)
class Header:
    version: str
    point_format: int
    record_length: int
    n_points: int
    data_offset: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    crs: str | None
    compressed: bool


def read_header(uri: str) -> Header:
    """What the header and the projection records say; crs as EPSG:<code> or the WKT text, None if absent."""
    with open_file(uri) as f:
        h = f.read(375)
        if h[:4] != b"LASF":
            raise ValueError(f"{uri} isn't a LAS file")
        (size,), (start, n_records) = struct.unpack_from("<H", h, 94), struct.unpack_from("<II", h, 96)
        form, length, count = struct.unpack_from("<BHI", h, 104)
        numbers = struct.unpack_from("<12d", h, 131)
        if (h[24], h[25]) >= (1, 4) and size >= 375:
            (count,) = struct.unpack_from("<Q", h, 247)
        crs = None
        f.seek(size)
        for _ in range(n_records):
            head = f.read(54)
            if len(head) < 54:
                break
            record, bytes_after = struct.unpack_from("<HH", head, 18)
            body = f.read(bytes_after)
            if head[2:18].rstrip(b"\0") == b"LASF_Projection":
                if record == 2112:
                    crs = body.rstrip(b"\0").decode("utf-8", "replace")
                elif record == 34735 and crs is None:
                    keys = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2])
                    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
                    code = codes.get(3072) or codes.get(2048)
                    crs = f"EPSG:{code}" if code else None
    m = numbers[6:]
    return Header(f"{h[24]}.{h[25]}", form & 0x3F, length, count, start, numbers[:3], numbers[3:6], (m[1], m[3], m[5]), (m[0], m[2], m[4]), crs, bool(form & 0xC0))


def check_reference(header: Header, wanted: str, uri: str) -> None:
    """Raises if the header names EPSG codes and the wanted one isn't among them. WKT without codes passes."""
    codes = re.findall(r"EPSG:(\d+)", header.crs or "", re.I) or re.findall(r'(?:AUTHORITY|ID)\[\s*"EPSG"\s*,\s*"?(\d+)', header.crs or "")
    if codes and wanted.upper().startswith("EPSG:") and wanted[5:] not in codes:
        raise WrongReference(f"{uri} is in EPSG:{codes[-1]}, not in {wanted}")


def _laz_points(uri: str, first: int, n: int) -> Iterator[dict[str, np.ndarray]]:
    try:
        import laspy
    except ImportError as e:
        raise CompressedPoints(f"{uri} is LAZ-compressed; install laspy with a LAZ backend, or convert it to LAS or Parquet") from e
    with open_file(uri) as f, laspy.open(f) as points:
        points.seek(first)
        while n > 0:
            rows = points.read_points(min(n, POINTS_PER_BATCH))
            if not len(rows):
                raise ValueError(f"{uri} ends before its last point")
            n -= len(rows)
            yield {k: np.asarray(getattr(rows, k), float) for k in "xyz"} | {"cls": np.asarray(rows.classification).astype(np.int16)}


def read_points(uri: str, first: int, n: int, header: Header) -> Iterator[dict[str, np.ndarray]]:
    """x, y, z and class of points first to first + n, some at a time."""
    if header.compressed:
        yield from _laz_points(uri, first, n)
        return
    kind = np.dtype({"names": ["X", "Y", "Z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, 16 if header.point_format >= 6 else 15], "itemsize": header.record_length})
    with open_file(uri) as f:
        f.seek(header.data_offset + first * header.record_length)
        while n > 0:
            take = min(n, POINTS_PER_BATCH)
            rows = np.frombuffer(f.read(take * header.record_length), kind)
            if len(rows) < take:
                raise ValueError(f"{uri} ends before its last point")
            n -= take
            cls = rows["c"] if header.point_format >= 6 else rows["c"] & 0x1F
            yield {k: rows[k.upper()] * header.scale[j] + header.offset[j] for j, k in enumerate("xyz")} | {"cls": cls.astype(np.int16)}


def tile_of(uri: str) -> str:
    return uri.rpartition("/")[2].rpartition(".")[0]


@dataclass
class Part(InputPartition):
    uri: str
    first: int
    n: int
    header: Header

    def __post_init__(self):
        super().__init__(self.uri)


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.missing_ok = options["path"], options.get("ignoreMissingFiles", "false").lower() == "true"
        self.reference, self.laz = options.get("crs", ""), options.get("lidarReader", "laspy") == "laspy"
        self.classes = [int(c) for c in options["classes"].split(",")] if "classes" in options else None
        self.tiles = set(options["tiles"].split("/")) if "tiles" in options else None

    def partitions(self) -> list[Part]:
        files = []
        for path in self.path.split(","):
            try:
                files += [f for f in list_files(path.strip(), (".las", ".laz")) if self.tiles is None or tile_of(f) in self.tiles]
            except FileNotFoundError:
                if self.missing_ok:
                    continue
                raise
        out = []
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:  # 400 bytes a file, of the wanted tiles only
            for uri, h in zip(files, pool.map(read_header, files)):
                if h.compressed and not self.laz:
                    raise CompressedPoints(f"{uri} is LAZ-compressed; set lidar_reader to laspy, or convert it to LAS or Parquet")
                if self.reference:
                    check_reference(h, self.reference, uri)
                out += [Part(uri, k, min(POINTS_PER_PARTITION, h.n_points - k), h) for k in range(0, h.n_points, POINTS_PER_PARTITION)]
        return out

    def read(self, part: Part):
        import pyarrow as pa

        if part is None:  # no file at all
            return
        name = tile_of(part.uri)
        for p in read_points(part.uri, part.first, part.n, part.header):
            keep = np.isin(p["cls"], self.classes) if self.classes is not None else np.ones(len(p["cls"]), bool)
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(keep.sum()), pa.string()), *[pa.array(p[k][keep]) for k in ("x", "y", "z", "cls")]], ["tile_id", "x", "y", "z", "cls"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def read_las(spark: SparkSession, path: str, ignore_missing: bool = False, crs: str = "", lidar_reader: str = "laspy", tiles: Iterable[str] | None = None, classes: Iterable[int] | None = None) -> DataFrame:
    """Points of a LAS file, or of all in a folder; tile_id is the file's name without suffix. Only files of `tiles` are
    opened, only points of `classes` leave the reader. These are options, not filters that are pushed down: a Python data
    source keeps the filters of a table's first query for its later ones. crs: the EPSG code that files must not
    contradict. lidar_reader laspy also reads LAZ where laspy is installed."""
    spark.dataSource.register(LasSource)
    options = {"ignoreMissingFiles": str(ignore_missing).lower(), "crs": crs, "lidarReader": lidar_reader}
    if tiles is not None:
        options["tiles"] = "/".join(tiles)
    if classes is not None:
        options["classes"] = ",".join(map(str, classes))
    return spark.read.format("las").options(**options).load(path)
