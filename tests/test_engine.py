"""Assignment, mounting, statistics, whole runs, and the registered queries against DuckDB."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sunplane.config import Config
from sunplane.functions import kernels, shapes
from sunplane.operators import assign, points as pt, stats
from sunplane.operators.mounting import RuleClassifier, is_tracker_suspected
from sunplane.plans import engine, queries
from sunplane.schema import OUTPUT

SF = "/root/testdata/sf0.001"
RINGS = shapes.RINGS


def box(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


def table(spark, ident, boxes):
    return engine.with_measures(spark.createDataFrame([(k, box(*b)) for k, b in boxes.items()], f"{ident} string, rings {RINGS}"))


@pytest.fixture(scope="module")
def assigned(spark):
    tiles = table(spark, "tile_id", {"t1": (0, 0, 100, 100), "t2": (100, 0, 200, 100), "t3": (0, 100, 100, 200)})
    polygons = table(spark, "polygon_id", {"in": (10, 10, 20, 20), "span": (85, 10, 105, 20), "off": (500, 500, 510, 510), "edge": (90, 50, 110, 60), "top": (10, 95, 20, 120)})
    return assign.assign(polygons, tiles, 50.0)


def test_assignment(assigned):
    got = {r["polygon_id"]: (r["primary_tile_id"], r["overlapping_tile_ids"]) for r in assigned.collect()}
    assert got == {"in": ("t1", ["t1"]), "span": ("t1", ["t1", "t2"]), "top": ("t3", ["t1", "t3"])}  # a centroid on a side is in no tile


def test_groups_and_missing_tiles(spark, assigned):
    groups = assign.tile_groups(assigned)
    got = {r["primary_tile_id"]: (r["polygon_ids"], r["fetch_tile_ids"], r["partition_id"]) for r in groups.collect()}
    assert got == {"t1": (["in", "span"], ["t1", "t2"], 0), "t3": (["top"], ["t1", "t3"], 1)}
    have = spark.createDataFrame([("t1",), ("t1",)], "tile_id string")
    assert [(r["primary_tile_id"], r["fetch_tile_ids"]) for r in assign.with_data(groups, have).collect()] == [("t1", ["t1"])]
    assert [r["partition_id"] for r in assign.pending(groups, spark.createDataFrame([(0,)], "partition_id int")).collect()] == [1]


def test_class_choice(spark):
    rows = [("a", 6, 5.0), ("a", 2, 0.0), ("b", 1, 3.0), ("b", 2, 1.0), ("b", 2, 2.0), ("c", 1, 3.0)]
    points = spark.createDataFrame([(t, 0.0, 0.0, z, c) for t, c, z in rows], "tile_id string, x double, y double, z double, cls int")
    fetch = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "b"), ("g3", "c"), ("g4", "none")], "group string, tile_id string")
    got = {r["group"]: (r["panel_class"], r["least_z"]) for r in pt.class_choice(points, fetch).collect()}
    assert got == {"g1": (6, None), "g2": (1, 3.0), "g3": (1, None), "g4": (1, None)}
    lit = F.lit
    assert spark.range(1).select(pt.is_panel(lit(1), lit(3.0), lit(1), lit(3.0)), pt.is_panel(lit(1), lit(3.1), lit(1), lit(3.0)), pt.is_panel(lit(1), lit(0.0), lit(1), lit(None).cast("double"))).first()[:] == (False, True, True)


def test_footprint_pick_and_neighbours(spark):
    polygons = table(spark, "polygon_id", {"p": (0, 0, 10, 10), "q": (13, 0, 20, 10), "far": (400, 0, 410, 10)})
    buildings = table(spark, "building_id", {"big": (0, 0, 9, 9), "tiny": (9, 9, 10, 10), "same1": (14, 1, 16, 3), "same0": (17, 1, 19, 3)})
    assert {r["polygon_id"]: r["building_id"] for r in pt.pick_footprints(polygons, buildings).collect()} == {"p": "big", "q": "same0"}
    assert {r["polygon_id"]: len(r["other_edges"]) for r in pt.neighbours(polygons, 5.0).collect()} == {"p": 1, "q": 1}
    assert pt.neighbours(polygons, 1.0).count() == 0


def test_heights(spark):
    polygons = table(spark, "polygon_id", {"p": (0, 0, 4, 4)})
    points = spark.createDataFrame([("t", 12.0, 2.0, 10.0, 2), ("t", 12.01, 2.0, 99.0, 2), ("t", 2.0, 2.0, 12.0, 2), ("t", 2.0, 2.0, 5.0, 6)], "tile_id string, x double, y double, z double, cls int")
    ground = pt.ground_in_disc(points, polygons)
    assert sorted(r["z"] for r in ground.collect()) == [10.0, 12.0]
    panel = spark.createDataFrame([("p", 13.0), ("p", 15.0), ("lonely", 1.0)], "polygon_id string, z double")
    assert {r["polygon_id"]: r["hag"] for r in pt.height_above_ground(panel, ground).collect()} == {"p": 3.0, "lonely": None}
    assert pt.ground_in_square(points, polygons, least=3).first()["ground_z"] == 12.0


FEATURES = "on_building boolean, roof_available boolean, tilt double, panel_roof_angle double, height_above_roof double, height_above_ground double, aspect_ratio double"
CASES = [
    ((True, True, 5.0, 2.0, 0.2, 4.0, 1.5), "R1", 1.0),
    ((True, True, 5.0, 6.0, 1.6, 4.0, 1.5), "R6", 1 - 13 / 30),
    ((True, True, 5.0, 20.0, 0.6, 4.0, 1.5), "R2", 1.0),
    ((True, False, 10.0, None, None, 5.0, 1.5), "R2", 1.0),
    ((False, False, 3.0, None, None, 4.0, 5.0), "R3", 1.0),
    ((False, False, 10.0, None, None, 0.5, 8.0), "R4", 1.0),
    ((False, False, 10.0, None, None, 0.5, 1.5), "R5", 1.0),
    ((False, False, 20.0, None, None, 2.0, 4.0), "R3", 0.5),
    ((True, False, None, None, None, 0.0, None), "R6", 1.0),
    ((True, True, 5.0, 5.0, -3.0, 0.0, 1.0), "R1", 0.5),
]


def test_rules(spark):
    df = spark.createDataFrame([c[0] for c in CASES], FEATURES).withColumn("i", F.monotonically_increasing_id()).coalesce(1)
    got = [r["m"] for r in df.orderBy("i").select(RuleClassifier().classify({c: F.col(c) for c in df.columns}).alias("m")).collect()]
    assert [g["rule"] for g in got] == [c[1] for c in CASES]
    assert [g["confidence"] for g in got] == pytest.approx([c[2] for c in CASES])
    t = lambda on, a, h, s: is_tracker_suspected(F.lit(on), F.lit(a).cast("double"), F.lit(h), F.lit(s))
    assert spark.range(1).select(t(False, 4.0, 1.9, 34.0), t(True, 9.0, 1.0, 1.0), t(False, None, 1.0, 1.0), t(False, 4.0, 2.0, 1.0)).first()[:] == (True, False, False, False)


def test_parts(spark):
    rows = [("a", 1, [box(0, 0, 1, 1), box(2, 0, 3, 1)]), ("b", 2, [box(0, 0, 1, 1)]), ("c", 3, [box(0, 0, 1, 1)]), ("c", 4, [box(5, 0, 6, 1)])]
    df = spark.createDataFrame(rows, f"polygon_id string, ord int, parts array<{RINGS}>")
    assert sorted((r["polygon_id"], r["parent_polygon_id"]) for r in assign.explode_parts(df, "parts", "ord").collect()) == [("a__p0", "a"), ("a__p1", "a"), ("b", "b"), ("c__p0", "c"), ("c__p1", "c")]
    assert assign.explode_parts(df, "parts", "ord", explode=False).filter("parent_polygon_id = polygon_id").count() == 4


def made_scene(spark, noise=0.01):
    """One panel of 20 degrees facing south on a roof of 5 degrees, ground around."""
    rng = np.random.default_rng(7)
    tilted = lambda xy, t, at: at - math.tan(math.radians(t)) * (xy[:, 1] - 50) * -1.0
    ground, roof, panel = rng.uniform(0, 100, (4000, 2)), rng.uniform(35, 65, (6000, 2)), rng.uniform(45, 55, (800, 2))
    covered = (np.abs(roof - 50) < 5).all(axis=1)
    roof = roof[~covered]
    rows = [("t", *map(float, p), 0.0, 2) for p in ground]
    rows += [("t", *map(float, p), float(z), 6) for p, z in zip(roof, tilted(roof, 5, 6.0) + rng.normal(0, noise, len(roof)))]
    rows += [("t", *map(float, p), float(z), 6) for p, z in zip(panel, tilted(panel, 20, 7.5) + rng.normal(0, noise, len(panel)))]
    points = spark.createDataFrame(rows, "tile_id string, x double, y double, z double, cls int")
    shape = lambda ident, b: spark.createDataFrame([(ident[1], box(*b))], f"{ident[0]} string, rings {RINGS}")
    return points, shape(("polygon_id", "p1"), (45, 45, 55, 55)), shape(("building_id", "b1"), (35, 35, 65, 65)), shape(("tile_id", "t"), (0, 0, 100, 100))


def test_whole_row(spark):
    points, polygons, buildings, tiles = made_scene(spark)
    rows = engine.build_rows(points, polygons, buildings, tiles, Config.from_dict({"compute": {"tile_cell_size_m": 100.0}}), "run")
    assert rows.schema.names == OUTPUT.names and [f.dataType for f in rows.schema] == [f.dataType for f in OUTPUT]
    r = rows.first()
    assert abs(r["panel_tilt_deg"] - 20) < 0.5 and abs(r["panel_azimuth_deg"] - 180) < 1.5 and r["panel_rmse_m"] < 0.05
    assert abs(r["roof_tilt_deg"] - 5) < 0.5 and abs(r["roof_azimuth_deg"] - 180) < 3 and abs(r["panel_roof_angle_deg"] - 15) < 1
    assert abs(r["height_above_roof_m"] - 1.5) < 0.1 and abs(r["height_above_ground_m"] - 7.5) < 0.2
    assert (r["building_id"], r["on_building"], r["mounting_type"], r["mounting_rule"], r["n_planes_detected"]) == ("b1", True, "tilted_rack_rooftop", "R2", 1)
    assert r["flags"] == [] and r["lidar_tile_ids"] == ["t"] and 0 < r["panel_tilt_unc_deg"] < 1 and r["area_m2"] == 100 and r["aspect_ratio"] == pytest.approx(1)
    assert kernels.read_wkb(bytes(r["geometry"])) == [[[(p["x"], p["y"]) for p in box(45, 45, 55, 55)[0]]]]
    again = engine.build_rows(points.repartition(5), polygons, buildings, tiles, Config.from_dict({"compute": {"tile_cell_size_m": 100.0, "cell_size_m": 7.0}}), "run").drop("config_hash").first()
    assert {k: v for k, v in r.asDict().items() if k != "config_hash"} == again.asDict()


def test_points_are_read_twice_and_only_where_they_are_fetched(spark, tmp_path):
    """Scans are counted in the plans as they are built, before adaptive execution reuses any."""
    points, polygons, buildings, tiles = made_scene(spark)
    far = points.withColumns({"tile_id": F.concat(F.lit("far"), (F.col("x") / 10).cast("int")), "x": F.col("x") + 1000})
    path = str(tmp_path / "points")
    points.unionByName(far).write.partitionBy("tile_id").parquet(path)
    table = spark.read.parquet(path)
    surveyed = []
    find = pt.survey_tiles
    pt.survey_tiles = lambda *a: surveyed.append(find(*a)) or surveyed[-1]
    try:
        rows = engine.build_rows(table, polygons, buildings, tiles, Config.from_dict({"compute": {"tile_cell_size_m": 100.0}}), "run")
    finally:
        pt.survey_tiles = find
    of_points = lambda df: [p for p in df._jdf.queryExecution().sparkPlan().toString().split("\n") if re.search(r"FileScan parquet \[.*cls#.*tile_id#", p)]
    assert len(surveyed) == 1 and len(of_points(surveyed[0])) == 1 and len(of_points(rows)) == 1
    assert all("dynamicpruning" in p for df in (surveyed[0], rows) for p in of_points(df))
    assert rows.first()["n_points_panel"] > 500


def test_a_classifier_of_the_callers(spark):
    class Always:
        def classify(self, features):
            return F.struct(F.lit("carport").alias("label"), F.lit(0.75).alias("confidence"), F.lit("own").alias("rule"))

    points, polygons, buildings, tiles = made_scene(spark)
    r = engine.build_rows(points, polygons, buildings, tiles, Config.from_dict({"compute": {"tile_cell_size_m": 100.0}}), "run", classifier=Always()).first()
    assert (r["mounting_type"], r["mounting_confidence"], r["mounting_rule"]) == ("carport", 0.75, "own")


def test_configured_classes(spark):
    points, polygons, buildings, tiles = made_scene(spark)
    other = points.withColumn("cls", F.when(F.col("cls") == 6, 17).when(F.col("cls") == 2, 9).otherwise(F.col("cls")))
    classes = {"panel_class_primary": 17, "ground_class": 9}
    config = {"compute": {"tile_cell_size_m": 100.0}}
    want = engine.build_rows(points, polygons, buildings, tiles, Config.from_dict(config), "run").drop("config_hash").first()
    got = engine.build_rows(other, polygons, buildings, tiles, Config.from_dict(config | {"io": {"classification": classes}}), "run").drop("config_hash").first()
    assert got == want
    fallback = points.withColumn("cls", F.when(F.col("cls") == 6, 5).otherwise(F.col("cls")))
    low = engine.build_rows(fallback, polygons, buildings, tiles, Config.from_dict(config | {"io": {"classification": {"panel_class_fallback": 5}}}), "run").drop("config_hash").first()
    assert low["n_points_panel"] == want["n_points_panel"]


def test_kernels_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    turn = np.linspace(0, 2 * np.pi, 41)
    ring = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (1 + 0.3 * np.cos(5 * turn))[:, None]
    edges = np.concatenate([ring[:-1], ring[1:]], axis=1)
    x, y = rng.uniform(-1.5, 1.5, (2, 5000))
    whole = kernels.contains(edges, x, y), kernels.boundary_distance(edges, x, y)
    monkeypatch.setattr(kernels, "PAIRS_AT_ONCE", 100)
    assert (kernels.contains(edges, x, y) == whole[0]).all() and (kernels.boundary_distance(edges, x, y) == whole[1]).all()


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    df = spark.range(10).select("id", F.array_repeat(F.struct(F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), 100).alias("edges"), F.array(F.array(F.struct(F.lit(1.0).alias("a")))).alias("nested"))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(pt.small(df)) and not hinted(pt.small(df, 9)) and not hinted(pt.small(df, 10, 20_000)) and hinted(pt.small(df, 10, 100_000))


def test_polygons_without_points_and_missing_tiles(spark):
    points, polygons, buildings, tiles = made_scene(spark)
    config = Config.from_dict({"compute": {"tile_cell_size_m": 100.0}})
    bare = engine.build_rows(points.filter("x < 5"), polygons, buildings, tiles, config, "run").first()
    assert (bare["n_points_panel"], bare["panel_tilt_deg"], bare["flags"], bare["height_above_ground_m"]) == (0, None, ["low_density", "poor_fit", "roof_insufficient"], 0.0)
    assert engine.build_rows(points.limit(0), polygons, buildings, tiles, config, "run").count() == 0
    off = engine.build_rows(points, polygons, buildings.limit(0), tiles, config, "run").first()
    assert (off["on_building"], off["building_id"], off["roof_tilt_deg"], off["mounting_rule"]) == (False, None, None, "R6")


def test_statistics(spark):
    rows = spark.createDataFrame([("a", "R1", True, 1.0, 0.01, ["x"]), ("a", "R1", True, 0.5, None, []), ("b", "R6", False, 0.6, 0.03, ["x", "y"])], "mounting_type string, mounting_rule string, on_building boolean, mounting_confidence double, panel_rmse_m double, flags array<string>")
    s = stats.run_stats(rows)
    assert s["mounting_type_counts"] == {"a": 2, "b": 1} and s["flag_counts"] == {"x": 2, "y": 1} and (s["on_building_count"], s["off_building_count"]) == (2, 1)
    assert (s["mounting_confidence_p50"], s["panel_rmse_p50"]) == (0.6, 0.02)
    assert stats.run_stats(rows.limit(0))["panel_rmse_p90"] is None
    h = {r["bin"]: r["count"] for r in stats.histogram(spark.createDataFrame([(0.0,), (0.99,), (1.0,), (2.0,), (2.1,)], "v double"), "v", 0.0, 2.0, 2).collect()}
    assert h == {0: 2, 1: 2}


def test_a_configuration_file_with_every_section(tmp_path):
    text = {
        "crs": {"target": "EPSG:6341"},
        "panel_plane": {"erosion_m": 0.15, "min_density_pts_per_m2": 3, "uncertainty_method": "bootstrap"},
        "mounting_rules": {"R1": {"panel_roof_angle_deg_max": 6.0}, "R4": {"tilt_deg_max": 30.0}, "confidence_margin": 0.4},
        "io": {"lidar_reader": "laspy", "s3": {"requester_pays": False, "region": "us-east-2"}, "classification": {"panel_class_primary": 6, "fallback_height_above_ground_m": 1.5}},
        "compute": {"backend": "local", "elsewhere": {"n_workers": 40, "worker_memory": "8GiB"}, "local": {"n_workers": 3, "threads_per_worker": 2}},
        "output": {"partition_size": 100000, "write_geoparquet": True},
    }
    (tmp_path / "c.json").write_text(json.dumps(text))
    c = Config.from_file(str(tmp_path / "c.json"))
    t = c.mounting_rules.thresholds
    assert (t.flush_angle, t.tracker_tilt, t.margin, t.carport_height) == (6.0, 30.0, 0.4, 2.0)
    assert c.compute.spark_master == "local[6]" and c.compute.other["elsewhere"]["n_workers"] == 40
    assert Config().mounting_rules.thresholds == type(t)()
    for bad in ({"io": {"lidar_reader": "pdal"}}, {"compute": {"backend": "elsewhere"}}, {"compute": {"masters": "x"}}, {"mounting_rules": {"R9": {}}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


def test_configuration(tmp_path):
    assert Config().hash == Config.from_dict({}).hash != Config.from_dict({"panel_plane": {"max_iter": 10}}).hash
    for bad in ({"panel_plane": {"max_itr": 1}}, {"nope": 1}, {"panel_plane": {"max_iter": "x"}}, {"panel_plane": {"uncertainty_method": "none"}}, {"multi_plane": {"enabled": 1}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)
    (tmp_path / "c.json").write_text(json.dumps({"roof_plane": {"buffer_m": 2}}))
    assert Config.from_file(str(tmp_path / "c.json")).roof_plane.buffer_m == 2.0


def cell(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(map(cell, r)) for r in want.fetchall()), key=key)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_point_joins_are_equi_joins(spark):
    plan = __spark_entry__.queries()["panel_clip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_consensus_queries_do_the_whole_job(spark, monkeypatch):
    asked, fit = [], queries.planes.fit_groups
    monkeypatch.setattr(queries.planes, "fit_groups", lambda *a, **k: asked.append(k) or fit(*a, **k))
    for name in ("ransac_lcg", "bootstrap_lcg", "multi_plane_lcg"):
        queries.QUERIES[name](spark, SF)
    assert [k["iterations"] for k in asked] == [200] * 3 and asked[1]["samples"] == 50
