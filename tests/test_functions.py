import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunplane.functions import angles, kernels, names, projection, shapes
from sunplane.functions.confidence import conf_ge, conf_le, linear_confidence


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(v):
    return F.lit(v).cast("double") if v is None or isinstance(v, (int, float)) else v


def test_angles(spark):
    got = one(
        spark,
        flat=angles.azimuth(lit(0.0), lit(0.0), lit(1.0)),
        north=angles.azimuth(lit(0.0), lit(0.5), lit(1.0)),
        down=angles.azimuth(lit(-0.5), lit(0.0), lit(-1.0)),
        west=angles.azimuth(lit(-0.5), lit(0.0), lit(1.0)),
        tilt=angles.tilt(lit(1.0), lit(0.0), lit(-1.0)),
        wrap=angles.azimuth_difference(lit(350.0), lit(10.0)),
        half=angles.azimuth_difference(lit(190.0), lit(10.0)),
    )
    assert got["flat"] is None and got["wrap"] == -20 and got["half"] == -180
    assert got["north"] == pytest.approx(0) and got["down"] == pytest.approx(90) and got["west"] == pytest.approx(270) and got["tilt"] == pytest.approx(45)


def plane(nx, ny, nz, n=10, tilt=5.0):
    return F.struct(*[lit(v).alias(k) for k, v in {"nx": nx, "ny": ny, "nz": nz, "cx": 1.0, "cy": 2.0, "cz": 3.0, "tilt": tilt}.items()], F.lit(n).alias("n_inliers"))


def test_plane_angle_and_height(spark):
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    got = one(
        spark,
        same=angles.plane_angle(plane(0.6, 0.0, 0.8000000000000002), plane(0.6, 0.0, 0.8000000000000002)),
        thirty=angles.plane_angle(plane(0, 0, 1.0), plane(s, 0.0, c)),
        few=angles.plane_angle(plane(0, 0, 1.0, n=2), plane(0, 0, 1.0)),
        no_tilt=angles.plane_angle(plane(0, 0, 1.0), plane(0, 0, 1.0, tilt=None)),
        over=angles.height_over_plane(lit(1.0), lit(2.0), lit(3.5), plane(s, 0.0, c)),
        vertical=angles.height_over_plane(lit(1.0), lit(2.0), lit(3.5), plane(1.0, 0.0, 0.0)),
    )
    assert got["same"] == 0 and got["thirty"] == pytest.approx(30) and got["few"] is None and got["no_tilt"] is None
    assert got["over"] == pytest.approx(0.5) and got["vertical"] is None


def test_least_variance_normal_against_eigh(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        a = rng.normal(size=(3, 3)) * rng.uniform(0.01, 3, 3)
        rows.append((a @ a.T)[np.triu_indices(3)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "xx double, xy double, xz double, yy double, yz double, zz double")
    out = df.select("*", angles.least_variance_normal({c: F.col(c) for c in df.columns}).alias("v")).collect()
    for r in out:
        m = np.array([[r[0], r[1], r[2]], [r[1], r[3], r[4]], [r[2], r[4], r[5]]])
        v = np.linalg.eigh(m)[1][:, 0]
        assert np.allclose(list(r["v"]), v if v[2] >= 0 else -v, atol=1e-6)
    assert one(spark, v=angles.least_variance_normal({c: lit(0.0) for c in df.columns}))["v"] is None


@pytest.mark.parametrize(("value", "le", "ge"), [(2.0, 1, 0), (5.0, 0.5, 0.5), (8.0, 0, 1), (3.75, 0.75, 0.25), (None, 0, 0), (float("nan"), 0, 0), (-100.0, 1, 0)])
def test_confidences(spark, value, le, ge):
    got = one(spark, le=conf_le(lit(value), 5.0), ge=conf_ge(lit(value), 5.0), step=conf_ge(lit(value), 5.0, 0.0), zero=conf_le(lit(value), 0.0), linear=linear_confidence(lit(value), 5.0, 0.0))
    assert (got["le"], got["ge"]) == (le, ge)
    known = value is not None and not math.isnan(value)
    assert got["step"] == got["linear"] == float(known and value >= 5) and got["zero"] == float(known and value <= 0)


RINGS = [[[0.0, 0.0], [10.0, 0.0], [10.0, 8.0], [4.0, 3.0], [0.0, 8.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]


def test_shapes_against_kernels(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-2, 12), rng.uniform(-2, 10)) for _ in range(400)]
    rings = [[{"x": x, "y": y} for x, y in r] for r in RINGS]
    df = spark.createDataFrame([(rings, x, y) for x, y in points], f"rings {shapes.RINGS}, x double, y double").withColumn("e", shapes.edges(F.col("rings")))
    edges = np.array([[*a, *b] for r in RINGS for a, b in zip(r, r[1:])])
    x, y = np.array(points).T
    out = df.select(shapes.contains(F.col("e"), F.col("x"), F.col("y")).alias("i"), shapes.boundary_distance(F.col("e"), F.col("x"), F.col("y")).alias("d"), shapes.eroded_contains(F.col("e"), F.col("x"), F.col("y"), 0.3).alias("k")).collect()
    assert [r["i"] for r in out] == kernels.contains(edges, x, y).tolist()
    assert np.allclose([r["d"] for r in out], kernels.boundary_distance(edges, x, y))
    assert [r["k"] for r in out] == (kernels.contains(edges, x, y) & (kernels.boundary_distance(edges, x, y) > 0.3)).tolist()
    m = df.select(shapes.measures(F.col("rings")).alias("m"), shapes.bounds(F.col("rings")).alias("b")).first()
    assert m["m"]["area"] == pytest.approx(80 - 25 - 1) and tuple(m["b"]) == (0, 0, 10, 8)
    inside = kernels.contains(edges, *(g := np.stack(np.meshgrid(np.arange(0.005, 10, 0.01), np.arange(0.005, 8, 0.01))).reshape(2, -1)))
    assert (m["m"]["cx"], m["m"]["cy"]) == (pytest.approx(g[0][inside].mean(), abs=0.01), pytest.approx(g[1][inside].mean(), abs=0.01))


def test_boundary_is_outside_and_touching_intersects(spark):
    box = lambda *b: shapes.edges(shapes.box_rings(*[F.lit(float(v)) for v in b]))
    a = box(0, 0, 4, 4)
    got = one(
        spark,
        side=shapes.eroded_contains(a, lit(4.0), lit(2.0), 0.0),
        corner=shapes.eroded_contains(a, lit(0.0), lit(0.0), 0.0),
        mid=shapes.eroded_contains(a, lit(2.0), lit(2.0), 1.9),
        gone=shapes.eroded_contains(a, lit(2.0), lit(2.0), 2.0),
        touch=shapes.intersects(a, box(4, 4, 5, 5)),
        apart=shapes.intersects(a, box(4.1, 0, 5, 5)),
        within=shapes.intersects(a, box(1, 1, 2, 2)),
        around=shapes.intersects(a, box(-1, -1, 9, 9)),
        cross=shapes.intersects(a, box(1, -1, 2, 5)),
        empty=shapes.contains(F.array().cast(shapes.EDGES), lit(1.0), lit(1.0)),
    )
    assert got.asDict() == {"side": False, "corner": False, "mid": True, "gone": False, "touch": True, "apart": False, "within": True, "around": True, "cross": True, "empty": False}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=3, max_size=6), min_size=1, max_size=3), min_size=1, max_size=3))
def test_wkb_round_trip(polygons):
    assert kernels.read_wkb(kernels.write_wkb(polygons)) == polygons


def test_wkb_other_forms():
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 3) + struct.pack(">6d", *[v for p in ring for v in p])
    with_z = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 3) + struct.pack("<9d", *[v for p in ring for v in (*p, 7.0)])
    ewkb = struct.pack("<BIII", 1, 3 | 0x20000000, 4326, 1) + struct.pack("<I", 3) + struct.pack("<6d", *[v for p in ring for v in p])
    assert kernels.read_wkb(big) == kernels.read_wkb(with_z) == kernels.read_wkb(ewkb) == [[ring]]
    assert kernels.read_wkb(None) == [] and kernels.read_wkb(struct.pack("<BII", 1, 6, 0)) == []
    with pytest.raises(ValueError):
        kernels.read_wkb(struct.pack("<BIdd", 1, 1, 0, 0))


@pytest.mark.parametrize("turn", [0, 15, 37, 90, 123])
def test_aspect_of_turned_boxes(turn):
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    assert kernels.aspect_ratio([[(x * c - y * s, x * s + y * c) for x, y in ((0, 0), (8, 0), (8, 2), (0, 2), (0, 0))]]) == pytest.approx(4)


def test_aspect_without_a_shape():
    assert kernels.aspect_ratio(None) is None and kernels.aspect_ratio([]) is None and kernels.aspect_ratio([[(0, 0), (1, 1), (2, 2)]]) is None


def test_intersection_area():
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
    assert kernels.intersection_area(box(0, 0, 4, 4), box(2, 2, 6, 6)) == pytest.approx(4)
    assert kernels.intersection_area(box(0, 0, 4, 4)[::-1], [box(2, 2, 6, 6)[0][::-1]]) == pytest.approx(4)
    assert kernels.intersection_area(box(0, 0, 4, 4), box(5, 5, 6, 6)) == 0
    shape = [[tuple(p) for p in r] for r in RINGS]
    grid = np.stack(np.meshgrid(np.arange(0.025, 6, 0.05), np.arange(0.025, 6, 0.05))).reshape(2, -1)
    edges = np.array([[*a, *b] for r in RINGS for a, b in zip(r, r[1:])])
    assert kernels.intersection_area(shape, box(0, 0, 6, 6)) == pytest.approx(kernels.contains(edges, *grid).sum() * 0.0025, rel=0.02)


def test_names(spark):
    got = one(
        spark,
        uri=names.tile_uri("file:///a//", "{name}/x_{name}.las", F.lit("t1")),
        km=names.km_tile_name(lit(432999.0), lit(3719001.0)),
        low=names.area_bin(lit(5.0)),
        none=names.area_bin(lit(0.0)),
        feet=names.in_metres(lit(10.0), F.lit("US survey foot")),
        metres=names.in_metres(lit(10.0), F.lit("UTM zone 12N")),
    )
    assert tuple(got) == ("file:///a/t1/x_t1.las", "w0432n3719", "(0, 5]", None, 3.048, 10.0)


def test_identifiers(spark):
    df = spark.createDataFrame([(7, 1), (8, 2)], "Detection_ID long, extra int")
    assert [r["polygon_id"] for r in names.with_polygon_id(df).collect()] == ["7", "8"]
    with pytest.raises(ValueError):
        names.with_polygon_id(df.select("extra"))
    assert [r["building_id"] for r in names.with_building_id(df.withColumnRenamed("extra", "build_id")).collect()] == ["1", "2"]
    assert sorted((r["extra"], r["building_id"]) for r in names.with_building_id(df, ["extra"]).collect()) == [(1, "auto_0"), (2, "auto_1")]
    with pytest.raises(ValueError):
        names.with_building_id(df)


def test_projection_control_values_and_round_trip(spark):
    # The central meridian at the equator, and the meridian arc to 45 degrees north (4984944.378 m on GRS80) times 0.9996.
    east, north = projection.utm_forward(lit(-111.0), lit(0.0), 12)
    east45, north45 = projection.utm_forward(lit(-111.0), lit(45.0), 12)
    got = one(spark, e=east, n=north, e45=east45, n45=north45)
    assert (got["e"], got["n"]) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert (got["e45"], got["n45"]) == (pytest.approx(500000), pytest.approx(4984944.378 * 0.9996, abs=0.01))
    back = projection.utm_inverse(*projection.utm_forward(lit(-113.7), lit(33.45), 12), 12)
    got = one(spark, lon=back[0], lat=back[1])
    assert (got["lon"], got["lat"]) == (pytest.approx(-113.7, abs=1e-9), pytest.approx(33.45, abs=1e-9))
    corner = projection.slippy_corner(lit(100.0), lit(200.0), 10)
    got = one(spark, x=projection.slippy_tile(corner[0] + 1e-9, corner[1] - 1e-9, 10)[0], y=projection.slippy_tile(corner[0] + 1e-9, corner[1] - 1e-9, 10)[1])
    assert tuple(got) == (100, 200)


def test_numbering_over_many_partitions(spark):
    from sunplane.staging import numbered

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    out = numbered(df, ["k"], "place").collect()
    assert [r["k"] for r in sorted(out, key=lambda r: r["place"])] == sorted(r["k"] for r in out) and sorted(r["place"] for r in out) == list(range(5000))
    assert numbered(df.limit(0), ["k"], "place").count() == 0
