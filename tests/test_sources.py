"""Files written here and read back: LAS, GeoJSON, GeoPackage, shapefiles, Parquet; whole runs from files."""

import dataclasses
import json
import sqlite3
import struct
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import box, made_scene

from sunplane.cli import main
from sunplane.config import Config
from sunplane.functions import kernels
from sunplane.plans.run import Inputs, existing, ingest, run_pipeline
from sunplane.sources import las, vector
from sunplane.streaming.arrivals import measure_arrivals

SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
OTHER = [(20.0, 0.0), (20.0, 5.0), (25.0, 5.0), (25.0, 0.0), (20.0, 0.0)]


def write_las(path, points, version=(1, 4), form=6, wkt=b"", scale=0.001):
    """points: rows of x, y, z, class."""
    size = 375 if version >= (1, 4) else 227
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt if wkt else b""
    length = 30 if form == 6 else 20
    h = bytearray(size)
    h[:4], h[24:26] = b"LASF", bytes(version)
    struct.pack_into("<HII", h, 94, size, size + len(vlr), bool(vlr))
    struct.pack_into("<BHI", h, 104, form, length, 0 if version >= (1, 4) else len(points))
    low, high = (np.array(points)[:, :3].min(0), np.array(points)[:, :3].max(0)) if len(points) else ([0] * 3, [0] * 3)
    struct.pack_into("<12d", h, 131, *[scale] * 3, 100.0, 200.0, 0.0, high[0], low[0], high[1], low[1], high[2], low[2])
    if version >= (1, 4):
        struct.pack_into("<Q", h, 247, len(points))
    body = b""
    for x, y, z, c in points:
        r = bytearray(length)
        struct.pack_into("<3i", r, 0, round((x - 100) / scale), round((y - 200) / scale), round(z / scale))
        r[16 if form == 6 else 15] = int(c) | (0 if form == 6 else 0x20)
        body += bytes(r)
    path.write_bytes(bytes(h) + vlr + body)


def test_las(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(las, "POINTS_PER_PARTITION", 4)
    rows = [(100.5 + k, 200.25, k / 8, 2 + k % 3) for k in range(10)]
    write_las(tmp_path / "a.las", rows, wkt=b'PROJCS["x"]')
    write_las(tmp_path / "b.las", rows[:3], (1, 2), 0)
    write_las(tmp_path / "empty.las", [])
    df = las.read_las(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert np.allclose([g[1:] for g in got if g[0] == "a"], rows) and len([g for g in got if g[0] == "b"]) == 3
    assert df.filter(F.col("cls").isin(2, 3)).count() == 9 and df.filter("cls = 4").count() == 4 and df.count() == 13  # no filter stays
    assert las.read_las(spark, str(tmp_path), classes=[2, 3]).count() == 9
    h = las.read_header(str(tmp_path / "a.las"))
    assert (h.version, h.point_format, h.n_points, h.crs, h.compressed) == ("1.4", 6, 10, 'PROJCS["x"]', False) and h.low[0] == 100.5


def test_las_errors(spark, tmp_path):
    write_las(tmp_path / "z.laz", [(100.0, 200.0, 0.0, 2)], form=6)
    raw = bytearray((tmp_path / "z.laz").read_bytes())
    raw[104] |= 0x80
    (tmp_path / "z.laz").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="LAZ-compressed"):
        las.read_las(spark, str(tmp_path / "z.laz")).count()
    (tmp_path / "t.las").write_bytes(b"text")
    with pytest.raises(ValueError, match="isn't a LAS file"):
        las.read_header(str(tmp_path / "t.las"))
    assert las.read_las(spark, str(tmp_path / "missing.las"), ignore_missing=True).count() == 0
    with pytest.raises(Exception, match="missing"):
        las.read_las(spark, str(tmp_path / "missing.las")).count()


def test_files_of_other_tiles_are_not_opened(spark, tmp_path):
    write_las(tmp_path / "a.las", [(100.0, 200.0, 0.0, 2)])
    (tmp_path / "broken.las").write_bytes(b"text")
    df = las.read_las(spark, str(tmp_path))
    assert las.read_las(spark, str(tmp_path), tiles=["a", "none"]).count() == 1
    with pytest.raises(Exception, match="isn't a LAS file"):
        df.count()


def test_reference_systems_of_points(spark, tmp_path):
    write_las(tmp_path / "a.las", [(100.0, 200.0, 0.0, 2)], wkt=b'COMPD_CS["x",PROJCS["y",AUTHORITY["EPSG","6341"]],VERT_CS["z",AUTHORITY["EPSG","5703"]]]')
    assert las.read_las(spark, str(tmp_path), crs="EPSG:6341").count() == 1
    with pytest.raises(Exception, match="not in EPSG:26912"):
        las.read_las(spark, str(tmp_path), crs="EPSG:26912").count()


def test_compressed_points_through_an_installed_decoder(tmp_path, monkeypatch):
    class Rows:
        x, y, z, classification = [1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [2, 6]

        def __len__(self):
            return 2

    class Points:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def seek(self, n):
            self.at = n

        def read_points(self, n):
            return Rows()

    write_las(tmp_path / "z.laz", [(100.0, 200.0, 0.0, 2)])
    header = dataclasses.replace(las.read_header(str(tmp_path / "z.laz")), compressed=True, n_points=4)
    monkeypatch.setitem(sys.modules, "laspy", types.SimpleNamespace(open=lambda f: Points()))
    got = list(las.read_points(str(tmp_path / "z.laz"), 0, 4, header))
    assert len(got) == 2 and got[0]["cls"].tolist() == [2, 6] and got[1]["z"].tolist() == [5.0, 6.0]
    monkeypatch.setitem(sys.modules, "laspy", None)
    with pytest.raises(las.CompressedPoints):
        list(las.read_points(str(tmp_path / "z.laz"), 0, 4, header))


def geojson(path, rows, crs="EPSG:6341"):
    features = [{"type": "Feature", "properties": p, "geometry": {"type": "MultiPolygon", "coordinates": parts} if parts else None} for p, parts in rows]
    path.write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": f"urn:ogc:def:crs:{crs.replace(':', '::')}"}}, "features": features}))


def gpkg(path, rows):
    db = sqlite3.connect(path)
    db.execute("create table gpkg_contents (table_name text, data_type text)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id int)")
    db.execute("create table t (fid integer, build_id integer, geom blob)")
    db.execute("insert into gpkg_contents values ('t', 'features')")
    db.execute("insert into gpkg_geometry_columns values ('t', 'geom', 6341)")
    for k, parts in rows:
        db.execute("insert into t values (?, ?, ?)", (k, k, b"GP\0\x03" + struct.pack("<i4d", 6341, 0, 0, 0, 0) + kernels.write_wkb(parts)))
    db.commit()
    db.close()


def shapefile(folder, name, records):
    body = b""
    for k, rings in enumerate(records, 1):
        flat = [v for r in rings for p in r for v in p]
        starts = np.cumsum([0] + [len(r) for r in rings])[:-1]
        content = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(flat) // 2) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)
        body += struct.pack(">2i", k, len(content) // 2) + content
    (folder / f"{name}.shp").write_bytes(bytes(100) + body)
    at, index = 100, b""
    while at < 100 + len(body):
        (words,) = struct.unpack_from(">i", body, at - 96)
        index += struct.pack(">2i", at // 2, words)
        at += 8 + 2 * words
    (folder / f"{name}.shx").write_bytes(bytes(100) + index)
    head = bytearray(32 + 32 + 1)
    struct.pack_into("<IHH", head, 4, len(records), 65, 9)
    head[32:36], head[43], head[48], head[64] = b"Name", ord("C"), 8, 0x0D
    (folder / f"{name}.dbf").write_bytes(bytes(head) + b"".join(b" " + f"n{k}".ljust(8).encode() for k in range(len(records))))
    (folder / f"{name}.prj").write_text('PROJCS["NAD83(2011)",AUTHORITY["EPSG","6341"]]')


def test_polygons(spark, tmp_path):
    path = tmp_path / "p.geojson"
    geojson(path, [({"detection_id": 5, "extra": "e"}, [[SQUARE, HOLE], [OTHER]]), ({"detection_id": 6, "extra": None}, [[OTHER]])])
    rows = {r["polygon_id"]: r for r in vector.read_polygons(spark, str(path), "EPSG:6341").collect()}
    assert rows.keys() == {"5__p0", "5__p1", "6"} and rows["5__p0"]["parent_polygon_id"] == "5" and rows["5__p0"]["extra"] == "e"
    assert [len(r) for r in rows["5__p0"]["rings"]] == [5, 5] and kernels.read_wkb(bytes(rows["6"]["geometry"])) == [[OTHER]]
    assert [r["polygon_id"] for r in vector.read_polygons(spark, str(path), bbox=(-5, -5, 1, 1)).collect()] == ["5__p0", "5__p1"]  # the box comes before the parts
    assert [r["polygon_id"] for r in vector.read_polygons(spark, str(path), max_polygons=2).collect()] == ["5__p0", "5__p1"]
    assert vector.read_polygons(spark, str(path), explode_multipolygons=False).count() == 2
    with pytest.raises(ValueError, match="no transformation"):
        vector.read_polygons(spark, str(path), "EPSG:3857")


def test_parquet_and_reprojection(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ring = [(-111.0, 33.0), (-110.99, 33.0), (-110.99, 33.01), (-111.0, 33.0)]
    meta = {"geo": json.dumps({"primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB"}}})}
    table = pa.table({"polygon_id": ["a"], "geometry": [kernels.write_wkb([[ring]])]}).replace_schema_metadata(meta)
    pq.write_table(table, tmp_path / "p.parquet")
    assert vector.crs_of(str(tmp_path / "p.parquet")) == "EPSG:4326"
    r = vector.read_polygons(spark, str(tmp_path / "p.parquet"), "EPSG:6341").first()
    assert r["rings"][0][0]["x"] == pytest.approx(500000, abs=1e-6) and 3651000 < r["rings"][0][0]["y"] < 3652000
    pq.write_table(table.replace_schema_metadata(None), tmp_path / "q.parquet")
    with pytest.raises(ValueError, match="unknown"):
        vector.read_polygons(spark, str(tmp_path / "q.parquet"), "EPSG:6341")


def test_footprints_and_tiles(spark, tmp_path):
    gpkg(tmp_path / "f.gpkg", [(1, [[SQUARE, HOLE]]), (2, [[OTHER]])])
    f = {r["building_id"]: r["rings"] for r in vector.read_footprints(spark, str(tmp_path / "f.gpkg"), "EPSG:6341").collect()}
    assert f.keys() == {"1", "2"} and len(f["1"]) == 2
    shapefile(tmp_path, "tiles", [[SQUARE, HOLE], [OTHER]])
    with zipfile.ZipFile(tmp_path / "tiles.zip", "w") as z:
        for s in (".shp", ".dbf", ".prj"):
            z.write(tmp_path / f"tiles{s}", f"inner/tiles{s}")
    for uri in (str(tmp_path / "tiles.shp"), str(tmp_path / "tiles.zip")):
        t = {r["tile_id"]: r for r in vector.read_tile_index(spark, uri, "file:///las/", target_crs="EPSG:6341").collect()}
        assert t.keys() == {"n0", "n1"} and len(t["n0"]["rings"]) == 2 and t["n1"]["uri"] == "file:///las/n1.las"
    with pytest.raises(ValueError, match="isn't a vector format"):
        vector.read_features(str(tmp_path / "tiles.prj"))


def test_vector_files_in_parts(spark, tmp_path, monkeypatch):
    squares = [[(k + x, y) for x, y in SQUARE] for k in range(7)]
    gpkg(tmp_path / "f.gpkg", [(k, [[s]]) for k, s in enumerate(squares, 1)])
    shapefile(tmp_path, "f", [[s] for s in squares])
    monkeypatch.setattr(vector, "FEATURES_AT_ONCE", 3)
    for name in ("f.gpkg", "f.shp"):
        uri = str(tmp_path / name)
        df = vector.read_vector(spark, uri)
        reader = vector.VectorReader(uri, df.schema)
        parts = reader.partitions()
        assert len(parts) == 3
        assert [r for p in parts for r in reader.read(p)] == [tuple(r[:-1]) + (bytes(r[-1]),) for r in df.collect()]
    gpkg(tmp_path / "none.gpkg", [])
    assert vector.read_vector(spark, str(tmp_path / "none.gpkg")).count() == 0
    assert vector.read_vector(spark, str(tmp_path / "f.gpkg")).dtypes == [("fid", "bigint"), ("build_id", "bigint"), ("geometry", "binary")]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    points, polygons, buildings, tiles = made_scene(spark)
    (folder / "las").mkdir()
    rows = [(r["x"] + 1000, r["y"] + 1000, r["z"], r["cls"]) for r in points.collect()]
    write_las(folder / "las" / "t.las", rows)
    ring = lambda *b: [[[(p["x"] + 1000, p["y"] + 1000) for p in box(*b)[0]]]]
    geojson(folder / "polygons.geojson", [({"polygon_id": "p1"}, ring(45, 45, 55, 55)), ({"polygon_id": "off"}, ring(900, 900, 901, 901))])
    geojson(folder / "buildings.geojson", [({"building_id": "b1"}, ring(35, 35, 65, 65))])
    geojson(folder / "tiles.geojson", [({"Name": "t"}, ring(0, 0, 100, 100)), ({"Name": "missing"}, ring(100, 0, 200, 100))])
    return folder


def inputs(f, points="las"):
    return Inputs(str(f / "polygons.geojson"), str(f / "buildings.geojson"), str(f / "tiles.geojson"), str(f / points))


def test_run_resume_and_manifest(spark, files, tmp_path):
    out = str(tmp_path / "out")
    config = Config.from_dict({"output": {"also_write_csv": True}})
    m = run_pipeline(spark, config, inputs(files), out, run_id="r1")
    assert m["counts"] == {"polygons": 2, "tile_groups": 1, "attempted": 1, "succeeded": 1, "failed_groups": 0, "failed": 0}
    assert m["aggregate_stats"]["mounting_rule_counts"] == {"R2": 1} and m["lidar_tiles"] == ["t"] and json.loads((tmp_path / "out" / "manifest.json").read_text())["run_id"] == "r1"
    row = existing(spark, out).first()
    assert abs(row["panel_tilt_deg"] - 20) < 0.5 and row["run_id"] == "r1" and row["config_hash"] == config.hash
    run_pipeline(spark, config, inputs(files), out, run_id="r2")
    assert [r["run_id"] for r in existing(spark, out).collect()] == ["r1"]
    run_pipeline(spark, config, inputs(files), out, run_id="r3", resume=False)
    assert [r["run_id"] for r in existing(spark, out).collect()] == ["r3"]
    dry = run_pipeline(spark, config, inputs(files), str(tmp_path / "dry"), dry_run=True)
    assert dry["aggregate_stats"] == {"dry_run": True} and dry["counts"]["tile_groups"] == 1 and existing(spark, str(tmp_path / "dry")).count() == 0


def test_ingest_and_streaming(spark, files, tmp_path):
    table = str(tmp_path / "points.parquet")
    ingest(spark, str(files / "las"), table)
    direct = run_pipeline(spark, Config(), inputs(files), str(tmp_path / "a"), run_id="r")
    stored = run_pipeline(spark, Config(), Inputs(**(inputs(files).__dict__ | {"points": table})), str(tmp_path / "b"), run_id="r")
    assert direct["aggregate_stats"] == stored["aggregate_stats"]
    points, polygons, buildings, tiles = made_scene(spark)
    points.coalesce(1).write.parquet(str(tmp_path / "incoming"))
    config = Config.from_dict({"compute": {"tile_cell_size_m": 100.0}})
    for _ in range(2):
        measure_arrivals(spark, str(tmp_path / "incoming"), polygons, buildings, tiles, str(tmp_path / "rows"), str(tmp_path / "cp"), config).awaitTermination()
    assert [r["mounting_rule"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()] == ["R2"]


def test_command_line(files, tmp_path, capsys):
    assert main(["version"]) == 0
    (tmp_path / "c.json").write_text("{}")
    assert main(["validate-config", str(tmp_path / "c.json")]) == 0
    assert main(["describe-output"]) == 0
    assert main(["inspect-tile", str(files / "las" / "t.las")]) == 0
    text = capsys.readouterr().out
    assert Config().hash in text and "panel_tilt_deg: float" in text and '"version": "1.4"' in text
    with pytest.raises(SystemExit):
        main(["nothing"])
