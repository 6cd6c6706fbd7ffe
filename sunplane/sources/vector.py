"""Vector tables: rows of attributes and a `geometry` column of WKB, from Parquet, GeoJSON, GeoPackage or shapefiles
(zipped too), and the polygon, footprint and tile tables made from them."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sunplane.functions import names, projection, shapes
from sunplane.functions.kernels import Polygon, read_wkb, write_wkb
from sunplane.operators import assign
from sunplane.sources.files import open_file, suffix

PARTS = f"array<{shapes.RINGS}>"
#: What rows of a vector file look like before they are rows: attributes and polygons.
Feature = tuple[dict, list[Polygon]]


def _ring_area(r: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1])) / 2


def _inside(r: list, p: tuple) -> bool:
    odd = False
    for a, b in zip(r, r[1:] + r[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def read_geojson(text: str) -> tuple[list[Feature], str | None]:
    doc = json.loads(text)
    rows = []
    for f in doc["features"] if doc.get("type") == "FeatureCollection" else [doc]:
        g = f.get("geometry") or {}
        parts = {"Polygon": [g.get("coordinates")], "MultiPolygon": g.get("coordinates")}.get(g.get("type"), [])
        rows.append((f.get("properties") or {}, [[[(p[0], p[1]) for p in r] for r in part] for part in parts]))
    crs = ((doc.get("crs") or {}).get("properties") or {}).get("name", "EPSG:4326")
    code = re.search(r"EPSG:+(\d+)", crs)
    return rows, f"EPSG:{code[1]}" if code else "EPSG:4326" if crs.endswith("CRS84") else crs


def _gpkg(uri: str):
    """A connection to the file, where it lies if it is local, else to its bytes, and its first feature table: name, geometry
    column, reference system."""
    import sqlite3

    path = uri.removeprefix("file://")
    if os.path.exists(path):
        db = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)
    else:
        db = sqlite3.connect(":memory:")
        with open_file(uri) as f:
            db.deserialize(f.read())
    table, column, srs = db.execute("select c.table_name, g.column_name, g.srs_id from gpkg_contents c join gpkg_geometry_columns g using (table_name) where c.data_type = 'features' order by 1").fetchone()
    return db, '"' + table.replace('"', '""') + '"', column, f"EPSG:{srs}" if srs and srs > 0 else None


def read_gpkg(uri: str, first: int | None = None, last: int | None = None) -> list[Feature]:
    """The features, or those with rowids from first to last."""
    db, table, column, _ = _gpkg(uri)
    cursor = db.execute(f"select * from {table}" + ("" if first is None else f" where rowid between {first} and {last}"))
    fields = [d[0] for d in cursor.description]
    rows = []
    for values in cursor:
        row = dict(zip(fields, values))
        g = row.pop(column)
        parts: list[Polygon] = []
        if g and g[:2] == b"GP" and not g[3] & 0x10:
            parts = read_wkb(g[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[g[3] >> 1 & 7] :])
        rows.append((row, parts))
    db.close()
    return rows


def _gpkg_columns(uri: str) -> list[tuple[str, str]]:
    """Names and types as the table declares them."""
    db, table, column, _ = _gpkg(uri)
    kinds = (("BOOL", "boolean"), ("INT", "bigint"), ("REAL", "double"), ("DOUBLE", "double"), ("FLOAT", "double"))
    out = [(name, next((k for word, k in kinds if word in declared.upper()), "string")) for _, name, declared, *_ in db.execute(f"pragma table_info({table})") if name != column]
    db.close()
    return out


class Shapefile:
    """The files of a shapefile beside each other or in a zip, of which ranges are read."""

    def __init__(self, uri: str):
        self.uri, self.zip = uri.split("?")[0], None
        if suffix(uri) == ".zip":
            with open_file(self.uri) as f:
                self.zip = zipfile.ZipFile(io.BytesIO(f.read()))
            self.names = {n.lower(): n for n in self.zip.namelist()}
            self.stem = next((n[:-4] for n in sorted(self.names) if n.endswith(".shp")), None)
            if self.stem is None:
                raise ValueError(f"{uri} has no shapefile")

    def bytes(self, kind: str, start: int = 0, size: int | None = None) -> bytes | None:
        """Bytes of the file with this suffix, None if there is none."""
        if self.zip:
            name = self.names.get(self.stem + kind)
            return self.zip.read(name)[start : None if size is None else start + size] if name else None
        try:
            with open_file(self.uri[:-4] + kind) as f:
                f.seek(start)
                return f.read() if size is None else f.read(size)
        except FileNotFoundError:
            return None

    def reference(self) -> str | None:
        prj = (self.bytes(".prj") or b"").decode()
        code = re.search(r'AUTHORITY\["EPSG","?(\d+)"?\]\]\s*$', prj)
        return f"EPSG:{code[1]}" if code else prj or None

    def index(self) -> list[tuple[int, int]] | None:
        """Start and size of each record, from the .shx file."""
        shx = self.bytes(".shx")
        return [(2 * at, 2 * words + 8) for at, words in struct.iter_unpack(">2i", shx[100:])] if shx else None

    def fields(self) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
        """Of the attributes: number of rows, where the first one starts, their length, and (name, type, size, decimals)."""
        head = self.bytes(".dbf", 0, 32)
        if not head:
            return 0, 0, 0, []
        n, start, length = struct.unpack_from("<IHH", head, 4)
        table = self.bytes(".dbf", 32, start - 32) or b""
        out = []
        for k in range(0, len(table) - 31, 32):
            if table[k] == 0x0D:
                break
            out.append((table[k : k + 11].split(b"\0")[0].decode(), chr(table[k + 11]), table[k + 16], table[k + 17]))
        return n, start, length, out

    def columns(self) -> list[tuple[str, str]]:
        return [(name, "double" if kind == "F" or decimals else "bigint") if kind in "NF" else (name, "string") for name, kind, _, decimals in self.fields()[3]]

    def features(self, first: int = 0, records: list[tuple[int, int]] | None = None) -> list[Feature]:
        """All features, or those of the records, of which `first` is the first one's number."""
        start, size = (100, None) if records is None else (records[0][0], records[-1][0] + records[-1][1] - records[0][0])
        parts = read_shapes(self.bytes(".shp", start, size) or b"")
        n, head, length, fields = self.fields()
        rows: list[dict] = [{} for _ in parts]
        data = self.bytes(".dbf", head + first * length, len(rows) * length) if fields else b""
        for r in range(min(n - first, len(rows)) if fields else 0):
            k = r * length + 1
            for name, kind, size, decimals in fields:
                text = data[k : k + size].decode("utf-8", "replace").strip()
                rows[r][name] = None if not text else (float(text) if decimals or kind == "F" else int(text)) if kind in "NF" else text
                k += size
        return list(zip(rows, parts))


def read_shapes(records: bytes) -> list[list[Polygon]]:
    """Polygon records. Clockwise rings are shells; each other ring is a hole of the shell around it."""
    out, at = [], 0
    while at + 8 <= len(records):
        (words,) = struct.unpack_from(">i", records, at + 4)
        at += 8
        (kind,) = struct.unpack_from("<i", records, at)
        parts: list[Polygon] = []
        if kind in (5, 15, 25):
            n_rings, n_points = struct.unpack_from("<2i", records, at + 36)
            starts = [*struct.unpack_from(f"<{n_rings}i", records, at + 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", records, at + 44 + 4 * n_rings)
            points = list(zip(flat[::2], flat[1::2]))
            rings = [points[a:b] for a, b in zip(starts, starts[1:])]
            parts = [[r] for r in rings if _ring_area(r) <= 0]
            for hole in (r for r in rings if _ring_area(r) > 0):
                owner = next((p for p in parts if _inside(p[0], hole[0])), None)
                (owner.append(hole) if owner else parts.append([hole]))
        elif kind != 0:
            raise ValueError(f"shape type {kind} isn't a polygon")
        out.append(parts)
        at += 2 * words
    return out


#: Features that one partition of a file holds, where the format can be read in parts.
FEATURES_AT_ONCE = 50_000


def _unknown(uri: str) -> ValueError:
    return ValueError(f"{uri}: {suffix(uri) or 'no suffix'} isn't a vector format that is read here")


def read_features(uri: str) -> tuple[list[Feature], str | None]:
    """All features of a file and its reference system, by suffix."""
    kind = suffix(uri)
    if kind in (".geojson", ".json"):
        with open_file(uri.split("?")[0]) as f:
            return read_geojson(f.read().decode())
    if kind == ".gpkg":
        return read_gpkg(uri), crs_of(uri)
    if kind in (".shp", ".zip"):
        return Shapefile(uri).features(), crs_of(uri)
    raise _unknown(uri)


def _kind(values: list) -> str:
    types = {type(v) for v in values if v is not None}
    return "bigint" if types == {int} else "double" if types and types <= {int, float} else "boolean" if types == {bool} else "string"


@dataclass
class Features(InputPartition):
    """Rowids from first to last of a GeoPackage, records from number `first` of a shapefile, or a whole file."""

    first: int | None = None
    last: int | None = None
    records: list[tuple[int, int]] | None = None

    def __post_init__(self):
        super().__init__(self.first)


class VectorReader(DataSourceReader):
    def __init__(self, uri: str, schema):
        self.uri, self.fields = uri, [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[Features]:
        kind = suffix(self.uri)
        if kind == ".gpkg":
            db, table, *_ = _gpkg(self.uri)
            low, high = db.execute(f"select min(rowid), max(rowid) from {table}").fetchone()
            db.close()
            return [Features(k, min(k + FEATURES_AT_ONCE - 1, high)) for k in range(low, high + 1, FEATURES_AT_ONCE)] if low is not None else []
        if kind == ".shp" and (index := Shapefile(self.uri).index()):
            return [Features(k, records=index[k : k + FEATURES_AT_ONCE]) for k in range(0, len(index), FEATURES_AT_ONCE)]
        return [Features()]

    def read(self, part: Features) -> Iterator[tuple]:
        cast = {"bigint": int, "double": float, "boolean": bool, "string": str}
        if part is None:  # no feature at all
            return
        if part.records:
            rows = Shapefile(self.uri).features(part.first, part.records)
        else:
            rows = read_features(self.uri)[0] if part.first is None else read_gpkg(self.uri, part.first, part.last)
        for row, parts in rows:
            values = [row.get(n) if n != "geometry" else None for n, _ in self.fields[:-1]]
            yield (*[None if v is None else cast[k](v) for v, (_, k) in zip(values, self.fields)], write_wkb(parts) if parts else None)


class VectorSource(DataSource):
    """A GeoPackage or a shapefile with an index is read in parts on the executors, and the driver reads its column types
    alone; GeoJSON, whose columns only its features tell, and zips are one partition."""

    @classmethod
    def name(cls) -> str:
        return "vector"

    def schema(self) -> str:
        uri = self.options["path"]
        if suffix(uri) == ".gpkg":
            columns = _gpkg_columns(uri)
        elif suffix(uri) in (".shp", ".zip"):
            columns = Shapefile(uri).columns()
        else:
            rows = [r for r, _ in read_features(uri)[0]]
            columns = [(c, _kind([r.get(c) for r in rows])) for c in dict.fromkeys(c for r in rows for c in r if c != "geometry")]
        return ", ".join([*[f"`{c}` {k}" for c, k in columns if c != "geometry"], "geometry binary"])

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"], schema)


def crs_of(uri: str) -> str | None:
    """The file's reference system: of Parquet the `geo` footer's EPSG code."""
    if suffix(uri) == ".gpkg":
        db, _, _, srs = _gpkg(uri)
        db.close()
        return srs
    if suffix(uri) in (".shp", ".zip"):
        return Shapefile(uri).reference()
    if suffix(uri) not in (".parquet", ".geoparquet", ".pq"):
        return read_features(uri)[1]
    import pyarrow.parquet as pq

    from sunplane.sources.files import list_files

    files = list_files(uri, (".parquet", ".geoparquet", ".pq"))
    if not files:
        return None
    with open_file(files[0]) as f:
        geo = (pq.read_schema(f).metadata or {}).get(b"geo")
    if not geo:
        return None
    meta = json.loads(geo)
    column = meta["columns"][meta["primary_column"]]
    if "crs" not in column:
        return "EPSG:4326"
    ident = (column["crs"] or {}).get("id")
    return f"{ident['authority']}:{ident['code']}" if ident else None


def read_vector(spark: SparkSession, uri: str) -> DataFrame:
    if suffix(uri) in (".parquet", ".geoparquet", ".pq"):
        return spark.read.parquet(uri)
    spark.dataSource.register(VectorSource)
    return spark.read.format("vector").load(uri)


def parse_parts(geometry: Column) -> Column:
    """WKB to parts: array of rings of each polygon; null for null."""

    @F.pandas_udf(PARTS)
    def parse(blobs):
        return blobs.map(lambda b: None if b is None else [[[{"x": x, "y": y} for x, y in r] for r in p] for p in read_wkb(b)])

    return parse(geometry)


#: UTM zones by EPSG code: WGS84, NAD83, and NAD83(2011).
def _zone(crs: str) -> tuple[int, bool] | None:
    code = int(m[1]) if (m := re.fullmatch(r"EPSG:(\d+)", crs, re.I)) else 0
    for first, last, base, south in ((32601, 32660, 32600, False), (32701, 32760, 32700, True), (26901, 26923, 26900, False), (6330, 6348, 6329, False)):
        if first <= code <= last:
            return code - base, south
    return None


def reprojector(source: str | None, target: str):
    """A function of x and y columns, or None where nothing is to be done. Unknown source systems, and pairs other than
    geographic and UTM ones, are errors rather than passed through."""
    if source is None:
        raise ValueError("the input's reference system is unknown")
    if source.lower() == target.lower():
        return None
    geographic = {"epsg:4326", "epsg:4269", "epsg:6318"}
    a, b = _zone(source), _zone(target)
    if source.lower() in geographic and b:
        return lambda x, y: projection.utm_forward(x, y, *b)
    if a and target.lower() in geographic:
        return lambda x, y: projection.utm_inverse(x, y, *a)
    if a and b:
        return lambda x, y: projection.utm_forward(*projection.utm_inverse(x, y, *a), *b)
    raise ValueError(f"no transformation from {source} to {target}")


def _moved(parts: Column, move) -> Column:
    if move is None:
        return parts

    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, point)))


def with_parts(df: DataFrame, source_crs: str | None, target_crs: str | None) -> DataFrame:
    return df.withColumn("parts", _moved(parse_parts(F.col("geometry")), reprojector(source_crs, target_crs) if target_crs else None))


def _boxed(df: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows of which some part intersects the box."""
    if bbox is None:
        return df
    frame = shapes.edges(shapes.box_rings(*map(F.lit, bbox)))
    return df.filter(F.exists("parts", lambda p: shapes.intersects(shapes.edges(p), frame)))


def read_polygons(spark: SparkSession, uri: str, target_crs: str | None = None, *, explode_multipolygons: bool = True, bbox=None, max_polygons: int | None = None, order: list[str] | None = None) -> DataFrame:
    """polygon_id, parent_polygon_id, rings, geometry and the other columns. The box is tested before multi-part polygons
    are taken apart, the number limited after, in the order of `order` (by default polygon_id). Rows that share an id count their
    parts in the order of `order` and then of the geometry's bytes."""
    rows = names.with_polygon_id(read_vector(spark, uri))
    rows = _boxed(with_parts(rows, crs_of(uri) if target_crs else None, target_crs), bbox)
    if explode_multipolygons:
        rows = assign.explode_parts(rows, "parts", [*(order or []), "geometry"]).drop("_pos", "parts", "geometry")
    else:
        rows = rows.withColumns({"parent_polygon_id": F.col("polygon_id"), "rings": F.flatten("parts")}).drop("parts", "geometry")
    rows = rows.withColumn("geometry", wkb_of(F.col("rings")))
    return rows if max_polygons is None else assign.first_polygons(rows, max_polygons, order or ["polygon_id"])


def wkb_of(rings: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(column):
        return column.map(lambda rs: None if rs is None else write_wkb([[[(p["x"], p["y"]) for p in r] for r in rs]]))

    return encode(rings)


def read_footprints(spark: SparkSession, uri: str, target_crs: str | None = None, *, id_col: str | None = None, order: list[str] | None = None, bbox=None) -> DataFrame:
    """building_id and rings (all parts), ids numbered before the box is applied where there are none."""
    rows = read_vector(spark, uri)
    rows = names.with_building_id(rows, order or [c for c in rows.columns if c != "geometry"] or ["geometry"], id_col)
    return _boxed(with_parts(rows, crs_of(uri) if target_crs else None, target_crs), bbox).withColumn("rings", F.flatten("parts")).drop("parts", "geometry")


def read_tile_index(spark: SparkSession, uri: str, base: str, template: str = "{name}.las", target_crs: str | None = None, name_col: str = "Name") -> DataFrame:
    """tile_id, rings, uri."""
    rows = with_parts(read_vector(spark, uri), crs_of(uri) if target_crs else None, target_crs)
    return rows.select(F.col(name_col).cast("string").alias("tile_id"), F.flatten("parts").alias("rings"), names.tile_uri(base, template, F.col(name_col).cast("string")).alias("uri"))
