import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunplane.functions import shapes
from sunplane.operators import planes
from sunplane.operators import points as pt
from sunplane.plans import engine


def surface(tilt, azimuth, n=300, noise=0.0, outliers=0.0, seed=1, shift=(0.0, 0.0, 10.0), extent=5.0):
    rng = np.random.default_rng(seed)
    t, a = math.radians(tilt), math.radians(azimuth)
    xy = rng.uniform(-extent / 2, extent / 2, (n, 2))
    z = -math.tan(t) * (xy[:, 0] * math.sin(a) + xy[:, 1] * math.cos(a)) + rng.normal(0, noise, n) if noise else -math.tan(t) * (xy[:, 0] * math.sin(a) + xy[:, 1] * math.cos(a))
    bad = rng.random(n) < outliers
    z = np.where(bad, z + rng.uniform(-3, 3, n), z)
    return np.column_stack([xy, z]) + np.array(shift)


def turn(a, b):
    return abs((a - b + 180) % 360 - 180)


@pytest.mark.parametrize("azimuth", [0, 45, 90, 135, 180, 225, 270, 315])
@pytest.mark.parametrize(("noise", "outliers"), [(0, 0), (0.01, 0), (0.01, 0.3)])
def test_planes_are_recovered(azimuth, noise, outliers):
    p = planes.fit_consensus(surface(20, azimuth, noise=noise, outliers=outliers), seed=5)
    assert abs(p.tilt - 20) < (1e-6 if not noise else 0.6) and turn(p.azimuth, azimuth) < (1e-6 if not noise else 1.5)


def test_failed_fits():
    assert planes.fit_consensus(np.zeros((2, 3))).n_inliers == 0
    line = np.column_stack([np.arange(50.0)] * 3)
    p = planes.fit_consensus(line)
    assert p.n_inliers == 0 and math.isnan(p.tilt) and p.normal.tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        planes.fit_consensus(np.zeros((10, 2)))


def test_weak_consensus_keeps_the_plane():
    pts = np.vstack([surface(10, 180, 100), surface(10, 180, 100) + [0, 0, 1.0]])
    p = planes.fit_consensus(pts, least_fraction=0.6)
    assert p.n_inliers == 100 and math.isnan(p.tilt) and not math.isnan(p.rmse) and planes.bootstrap(pts, p)[0] >= 0


def test_tilt_floor():
    assert math.isnan(planes.fit_consensus(surface(0.5, 90)).azimuth)
    assert not math.isnan(planes.fit_consensus(surface(0.5, 90), tilt_floor=0.1).azimuth)


def test_strict_threshold_and_first_of_equals():
    flat = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.05]], float)
    assert [planes.fit_consensus(flat, t, 0.0, picks=np.array([[0, 1, 2]])).n_inliers for t in (0.05, 0.0501)] == [3, 4]
    two = np.vstack([surface(30, 0, 50), surface(30, 180, 50, shift=(50, 0, 10))])
    a, b = np.array([[0, 1, 2]]), np.array([[50, 51, 52]])
    assert planes.fit_consensus(two, least_fraction=0, picks=np.vstack([a, b])).inliers[:50].all()
    assert planes.fit_consensus(two, least_fraction=0, picks=np.vstack([b, a])).inliers[50:].all()


def test_triples_are_different_and_even():
    for n in (3, 4, 17):
        t = planes.triples(99, n, 3000)
        assert all(len(set(row)) == 3 for row in t.tolist()) and t.min() == 0 and t.max() == n - 1
        counts = np.bincount(t.ravel(), minlength=n)
        assert counts.min() > 0.8 * counts.mean()


def test_bootstrap_grows_with_noise():
    low, high = (planes.bootstrap(pts, planes.fit_consensus(pts, 0.5, seed=2), 50, 2) for pts in (surface(20, 90, 80, 0.01), surface(20, 90, 80, 0.08)))
    assert 0 < low[0] < high[0] < 5 and 0 < low[1] < high[1]
    assert all(map(math.isnan, planes.bootstrap(np.zeros((2, 3)), planes.failed(2))))


def test_second_plane_and_rack(spark):
    pts = np.vstack([surface(20, 90, 400, 0.01, shift=(5, 0, 10)), surface(20, 270, 200, 0.01, shift=(-5, 0, 10))])
    first = planes.fit_consensus(pts, least_fraction=0.5, seed=3)
    second = planes.second_plane(pts, first, seed=3)
    assert turn(second.azimuth, 270) < 3 and abs(second.tilt - 20) < 1
    assert planes.second_plane(surface(20, 90, 200), planes.fit_consensus(surface(20, 90, 200))) is None
    lit = lambda v: F.lit(v).cast("double")
    rack = lambda a, b, c, d: planes.is_east_west_rack(lit(a), lit(b), lit(c), lit(d))
    assert spark.range(1).select(rack(20, 90, 20, 270), rack(20, 350, 21, 160), rack(20, 90, 26, 270), rack(20, 90, 20, 240), rack(20, None, 20, 270)).first()[:] == (True, True, False, False, False)


def test_groups_do_not_depend_on_partitions(spark):
    rows = [(f"p{k}", *map(float, xyz)) for k in range(6) for xyz in surface(10 + k, 40 * k, 60 + k, 0.02, 0.1, seed=k)] + [("none", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "polygon_id string, x double, y double, z double")
    fit = lambda d: sorted(map(tuple, planes.fit_groups(d, "polygon_id", samples=10, second=True).collect()), key=lambda r: r[0])
    once = fit(df.repartition(1))
    assert once == fit(df.repartition(7, "x")) and len(once) == 7
    assert next(r for r in once if r[0] == "none")[1:12] == (None,) * 9 + (0, 0)
    exact = {r["polygon_id"]: r for r in planes.fit_least_squares(df.dropna(), ["polygon_id"]).collect()}
    assert exact["p3"]["n"] == 63
    assert planes.fit_groups(df.limit(0), "polygon_id").count() == 0


def test_least_squares_equals_svd(spark):
    pts = surface(25, 200, 100, 0.05)
    got = planes.fit_least_squares(spark.createDataFrame([("a", *map(float, p)) for p in pts], "k string, x double, y double, z double"), ["k"]).first()
    _, normal = planes.pca_normal(pts)
    t, a = planes.tilt_azimuth(normal)
    assert got["tilt"] == pytest.approx(t, abs=1e-6) and got["azimuth"] == pytest.approx(a, abs=1e-6)


def test_all_points_where_consensus_is_low():
    rng = np.random.default_rng(12)
    loose = np.concatenate([rng.uniform(0, 5, (40, 2)), rng.uniform(0, 2, (40, 1))], axis=1)
    plain, whole = planes.fit_consensus(loose, seed=1), planes.fit_consensus(loose, seed=1, all_points=True)
    assert math.isnan(plain.tilt) and plain.n_inliers < 24
    assert whole.n_inliers == whole.n_total == 40 and not math.isnan(whole.tilt) and whole.rmse > 0.05
    tight = loose * [1, 1, 0] + [0, 0, 3]
    assert planes.fit_consensus(tight, seed=1, all_points=True).n_inliers == 40
    assert planes.fit_consensus(loose[:2], all_points=True).n_inliers == 0


def test_count_of_inliers_is_exact_and_ends_with_all(monkeypatch):
    rng = np.random.default_rng(5)
    for kind in range(40):
        pts = np.round(rng.uniform(-5, 5, (int(rng.integers(4, 200)), 3)) * 20) / 20 + [3000, 1000, 0]
        pts[:, 2] = 0.05 * rng.integers(0, 3, len(pts)) if kind % 2 else pts[:, 2]
        picks = planes.triples(kind, len(pts), 60)
        at, u, v = pts[picks[:, 0]], pts[picks[:, 1]] - pts[picks[:, 0]], pts[picks[:, 2]] - pts[picks[:, 0]]
        cross = np.cross(u, v)
        good = np.linalg.norm(cross, axis=1) > 1e-9
        normals = cross[good] / np.linalg.norm(cross[good], axis=1)[:, None]
        assert planes._first_best(pts, at[good], normals, 0.05) == np.argmax((planes._distances(pts, at[good], normals) < 0.05).sum(axis=1))
    monkeypatch.setattr(planes, "_distances", lambda pts, at, normals: pytest.fail("more planes tried") if len(at) > 16 else np.abs(((pts[None] - at[:, None]) * normals[:, None]).sum(axis=2)))
    assert planes.fit_consensus(surface(20, 90, 60, 0.001)).n_inliers == 60


def test_fits_of_polygons_that_share_their_points(spark):
    rng = np.random.default_rng(8)
    pts = [(float(x), float(y), float(0.3 * x + rng.uniform(0, 0.1))) for x, y in rng.uniform(-30, 30, (6000, 2))] + [(1.0, 1.0, None), (None, 0.0, 0.0)]
    points = spark.createDataFrame(pts, "x double, y double, z double")
    ring = lambda *c: [[{"x": float(x), "y": float(y)} for x, y in (*c, c[0])]]
    some = {f"p{k}": ring(*((x + a, y + b) for a, b in ((0, 0), (6, 0), (6, 4), (0, 4)))) for k, (x, y) in enumerate(rng.uniform(-28, 22, (30, 2)))}
    some |= {"tilted": ring((0, -4), (5, 0), (0, 4), (-5, 0)), "large": ring((-29, -29), (29, -29), (29, 29), (-29, 29)), "off": ring((90, 90), (95, 90), (95, 95), (90, 95)), "none": None}
    both = [*some.items(), ("p0", some["p1"]), (None, some["p2"])]
    polygons = engine.with_measures(spark.createDataFrame(both, f"polygon_id string, rings {shapes.RINGS}"))
    told = lambda df: sorted(([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()), key=str)
    want = told(planes.fit_groups(pt.clip(points, polygons), "polygon_id", samples=10))
    assert len(want) == 33 and told(planes.fit_clipped(points, polygons, samples=10)) == want


def test_points_go_to_a_crowd_once(spark):
    polygons = spark.range(40).select(F.col("id").cast("string").alias("polygon_id"), *[F.lit(v).alias(k) for k, v in (("x0", 1.0), ("y0", 1.0), ("x1", 4.0), ("y1", 4.0))])
    points = spark.range(50).select((F.col("id") / 10).alias("x"), F.lit(2.0).alias("y"), F.lit(0.0).alias("z"))
    dealt, housed = pt.by_home(points, polygons)
    assert dealt.count() == 31 and housed.select("home", "part").distinct().count() == 1
    dealt, housed = pt.by_home(points, polygons, most=10)
    parts = housed.select("home", "part").distinct().count()
    assert 1 < parts <= 4 and dealt.count() == 31 * parts
