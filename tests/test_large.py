"""What keeps the point queries whole on large tables: no large broadcast, no repeated work, and shortcuts that agree with the general way."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sunplane.config import Config
from sunplane.functions import kernels, shapes
from sunplane.operators import planes, points as pt
from sunplane.plans import engine, queries, scene

SF = "/root/testdata/sf0.001"


def boxes(spark, ident, rows):
    ring = lambda x0, y0, x1, y1: [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]
    return engine.with_measures(spark.createDataFrame([(k, ring(*b)) for k, b in rows.items()], f"{ident} string, rings {shapes.RINGS}"))


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(3)
    some = {f"p{k}": (x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.uniform(1, 9), y + rng.uniform(1, 9)) for k in range(40)}
    houses = {f"b{k}": (x := rng.uniform(-25, 10), y := rng.uniform(-25, 10), x + 18, y + 15) for k in range(6)}
    points = spark.createDataFrame([("t", rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(0, 9), 6) for _ in range(4000)], "tile_id string, x double, y double, z double, cls int")
    return points, boxes(spark, "polygon_id", some), boxes(spark, "building_id", houses)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_what_a_count_tells_too_large_is_not_broadcast(spark):
    df = spark.range(10)
    assert "Broadcast" in plan(spark.range(100).join(pt.small(df), "id"))
    assert "Broadcast" not in plan(spark.range(100).join(pt.small(df, 9), "id"))


def test_upright_rectangles_clip_as_any_shape(spark, crowd, monkeypatch):
    points, polygons, _ = crowd
    tilted = spark.createDataFrame([("d", [[{"x": float(x), "y": float(y)} for x, y in ((0, -3), (3, 0), (0, 3), (-3, 0), (0, -3))]])], f"polygon_id string, rings {shapes.RINGS}")
    bent = boxes(spark, "polygon_id", {"e": (0, 0, 2, 2)}).withColumn("edges", F.transform("edges", lambda e: e.withField("ax", F.when(e["ax"] == 2, 1.5).otherwise(e["ax"]))))
    assert pt.all_boxes(polygons) and not pt.all_boxes(engine.with_measures(tilted)) and not pt.all_boxes(bent)
    got = rows(pt.clip(points, polygons), "polygon_id", "x", "y")
    monkeypatch.setattr(pt, "all_boxes", lambda df: False)
    assert got and got == rows(pt.clip(points, polygons, size=25.0), "polygon_id", "x", "y")


def test_boxes_cells_hold_their_points(spark):
    df = spark.range(1).select(F.lit(-7.0).alias("x0"), F.lit(-3.0).alias("y0"), F.lit(6.0).alias("x1"), F.lit(4.0).alias("y1"))
    keys = [r["cell"] for r in shapes.by_cell(df, ("x0", "y0", "x1", "y1"), 5.0).collect()]
    assert len(keys) == len(set(keys)) == 8
    corner = spark.range(1).select(shapes.cell_key(F.lit(-7.0), F.lit(4.0), 5.0), shapes.cell_key(F.lit(6.0), F.lit(-3.0), 5.0)).first()
    assert set(corner) <= set(keys)


def test_rectangles_pick_footprints_as_any_shape(spark, crowd, monkeypatch):
    _, polygons, houses = crowd
    got = rows(pt.pick_footprints(polygons, houses), "polygon_id", "building_id")
    monkeypatch.setattr(pt, "all_boxes", lambda df: False)
    assert got and got == rows(pt.pick_footprints(polygons, houses), "polygon_id", "building_id")


def test_ring_of_rectangles_as_of_any_shape(spark, crowd):
    points, polygons, houses = crowd
    mine = polygons.join(pt.pick_footprints(polygons, houses), "polygon_id", "left")
    got = rows(pt.ring_of_boxes(points, mine), "polygon_id", "x", "y", "z", "d")
    assert got and got == rows(pt.ring_points(points, mine.join(pt.neighbours(mine, 5.0), "polygon_id", "left")), "polygon_id", "x", "y", "z", "d")


def test_ring_queries_make_no_list_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(pt, "neighbours", lambda *a, **k: pytest.fail("a list of neighbours for each polygon"))
    for name in ("ring_counts", "roof_lsq", "height_roof", "panel_roof_angle"):
        queries.QUERIES[name](spark, SF)


def test_equal_centroids_are_measured_once(spark, monkeypatch):
    polygons = boxes(spark, "polygon_id", {"a": (0, 0, 4, 4), "b": (1, 1, 3, 3), "c": (-1, 0, 5, 4), "far": (90, 90, 92, 92)})
    points = spark.createDataFrame([("t", float(k), 2.0, float(k), 2) for k in range(9)], "tile_id string, x double, y double, z double, cls int")
    asked, near = [], pt.near_polygons
    monkeypatch.setattr(pt, "near_polygons", lambda p, at, *a: asked.append(at.count()) or near(p, at, *a))
    assert rows(pt.ground_in_square(points, polygons), "polygon_id", "n_ground", "ground_z") == [(k, 9, 4.0) for k in "abc"]
    assert rows(pt.ground_heights(points, polygons, 3.0), "polygon_id", "ground_z") == [(k, 2.5) for k in "abc"]
    assert asked == [2, 2]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("l_returnflag#") and sum("Relation [l_orderkey" in p for p in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_residuals_need_one_clip(spark):
    assert scans(__spark_entry__.queries()["residual_rmse"](spark, SF)) == 1


def test_points_of_a_polygons_own_are_joined_by_it(spark):
    df = queries.QUERIES["multi_plane_lcg"](spark, SF)
    assert "cell" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lineitem_meets_part_before_it_becomes_points(spark):
    text = scene.points(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= text.index("Generate explode") < text.index("Relation [l_orderkey") and text.index("Generate explode") < text.index("p_partkey")


@pytest.mark.parametrize("name", ["ransac_lcg", "bootstrap_lcg"])
def test_consensus_queries_make_no_row_for_each_pair(spark, monkeypatch, name):
    monkeypatch.setattr(pt, "near_polygons", lambda *a, **k: pytest.fail("a row for each point and polygon"))
    assert queries.QUERIES[name](spark, SF).count()


def test_whole_run_makes_no_row_for_each_pair(spark, monkeypatch):
    for name in ("near_polygons", "neighbours"):
        monkeypatch.setattr(pt, name, lambda *a, **k: pytest.fail("a row for each polygon and what is near it"))
    queries.QUERIES["full_row"](spark, SF)


@pytest.mark.parametrize("most, block", [(512, 25.0), (3, 10.0)])
def test_blocks_tell_of_each_polygon_what_it_has_alone(spark, crowd, monkeypatch, most, block):
    """Boxes and other shapes, in one block or in many, with neighbours at home elsewhere and in another tile group."""
    points, polygons, houses = crowd
    ring = [[{"x": float(x), "y": float(y)} for x, y in ((-6, 0), (0, -5), (6, 0), (0, 5), (-6, 0))]]
    one = spark.createDataFrame([("d", ring)], f"polygon_id string, rings {shapes.RINGS}")
    tilted = spark.createDataFrame([("c", [[{"x": p["x"] * 3, "y": p["y"] * 3} for p in ring[0]]])], f"building_id string, rings {shapes.RINGS}")
    shaped, built = polygons.select("polygon_id", "rings").unionByName(one), houses.select("building_id", "rings").unionByName(tilted)
    points = points.withColumns({"cls": F.when(F.rand(4) < 0.3, 2).otherwise(6), "tile_id": F.when(F.col("x") < 3, "t").otherwise("u")})
    points = spark.createDataFrame(points.collect(), points.schema)
    tiles = boxes(spark, "tile_id", {"t": (-60, -60, 3, 60), "u": (3, -60, 60, 60)})
    whole = pt.by_block
    monkeypatch.setattr(pt, "by_block", lambda *a: whole(*a, block=block, most=most))
    config = Config.from_dict({"compute": {"tile_cell_size_m": 50.0}, "roof_plane": {"min_points": 10}})
    got = {r["polygon_id"]: r for r in engine.build_rows(points, shaped, built, tiles, config, "run").collect()}

    mine, near = {r["polygon_id"]: r for r in engine.with_measures(shaped).collect()}, engine.with_measures(built)
    sides = lambda e: np.array([[v["ax"], v["ay"], v["bx"], v["by"]] for v in e], float)
    picked = {r["polygon_id"]: sides(r["building_edges"]) for r in pt.pick_footprints(engine.with_measures(shaped), near).collect()}
    cloud = {k: np.array([(r["x"], r["y"], r["z"]) for r in points.collect() if r["cls"] == k]) for k in (2, 6)}
    group = {k: r["cx"] < 3 for k, r in mine.items()}
    fetched = {at: {t for k, r in mine.items() if group[k] == at for t, meets in (("t", r["x0"] <= 3), ("u", r["x1"] >= 3)) if meets} | {"t" if at else "u"} for at in (True, False)}
    assert len(got) == len(mine) == 41 and sum(r["roof_tilt_deg"] is not None or "roof_complex" in r["flags"] for r in got.values()) > 5
    for k, r in mine.items():
        pick = lambda p: p[[("t" if x < 3 else "u") in fetched[group[k]] for x in p[:, 0]]]  # noqa: B023, E731
        hits, soil = planes.in_order(pick(cloud[6])), pick(cloud[2])
        x, y = hits[:, 0], hits[:, 1]
        inside, d = kernels.contains(sides(r["edges"]), x, y), kernels.boundary_distance(sides(r["edges"]), x, y)
        pts, seed = hits[inside & (d > 0.15)], planes.stable_seed(k)
        p = planes.fit_consensus(pts, 0.05, 0.6, 200, 1.0, seed)
        assert (got[k]["n_points_panel"], got[k]["n_inliers_panel"]) == (len(pts), p.n_inliers)
        top, below = pts[p.inliers] if p.n_inliers else pts, soil[(soil[:, 0] - r["cx"]) ** 2 + (soil[:, 1] - r["cy"]) ** 2 <= 100, 2]
        hag = np.median(top[:, 2]) - np.median(below) if len(top) and len(below) else 0.0
        assert got[k]["height_above_ground_m"] == pytest.approx(hag, abs=1e-5)
        around = ~inside & (d > 0) & (kernels.contains(picked[k], x, y) if k in picked else False)
        for other, o in mine.items():
            if other != k and group[other] == group[k]:
                around &= ~kernels.contains(sides(o["edges"]), x, y)
        width = next((w for w in pt.Buffers().widths if (around & (d < w)).sum() >= 10), None)
        assert got[k]["on_building"] == (k in picked) and ("roof_insufficient" in got[k]["flags"]) == (k in picked and width is None)
        if width:
            roof = planes.fit_consensus(hits[around & (d < width)], 0.15, seed=seed)
            assert got[k]["roof_rmse_m"] == (None if math.isnan(roof.rmse) else pytest.approx(roof.rmse, abs=1e-5))


def test_points_cross_a_shuffle_some_hundred_at_a_time(spark):
    rows = [(k % 3, k % 2, 0, float(k), -float(k), k / 7, k % 5 == 0) for k in range(3000)]
    found = pt.packed(spark.createDataFrame(rows, "home long, gid int, part int, x double, y double, z double, is_panel boolean").coalesce(1)).collect()
    assert len(found) == 12
    for r in found:
        got = np.frombuffer(bytes(r["data"])).reshape(-1, 3)
        assert got.tolist() == [list(v[3:6]) for v in rows if (v[0], v[1], v[2], v[6]) == (r["home"], r["gid"], r["part"], r["is_panel"])]


def test_outlines_are_written_as_one_array(spark):
    ring = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    box, triangle = [ring((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))], [ring((0, 0), (9, 0), (9, 9), (0, 0)), ring((4, 1), (5, 1), (5, 2), (4, 1))]
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for some in ([box, box], [box, triangle], [None, box], [], [[]]):
        want = [None if rs is None else kernels.write_wkb([[[(p["x"], p["y"]) for p in r] for r in rs]]) for rs in some]
        assert kernels.write_wkb_rings(pa.array(some, kind)).to_pylist() == want
    assert kernels.write_wkb_rings(pa.array([triangle, box, box], kind).slice(1)).to_pylist() == [kernels.write_wkb([[[(p["x"], p["y"]) for p in box[0]]]])] * 2
