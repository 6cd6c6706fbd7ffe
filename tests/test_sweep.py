"""The size sweep: no rows for pairs or trials, trials' orders as md5 tells them, exact percentiles whatever was kept of the values."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from sunplane.operators import planes
from sunplane.operators import points as pt
from sunplane.operators import sweep
from sunplane.plans import queries

SF = "/root/testdata/sf0.001"


def swept(spark):
    return sorted(map(tuple, queries.QUERIES["size_sweep"](spark, SF).collect()))


@pytest.fixture(scope="module")
def whole(spark):
    return swept(spark)


def test_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(pt, "near_polygons", lambda *a, **k: pytest.fail("a row for each point and polygon"))
    assert queries.QUERIES["size_sweep"](spark, SF).count()


def test_percentiles_are_exact_where_a_part_told_their_place(spark, monkeypatch, whole):
    kept = []
    monkeypatch.setattr(sweep, "ALL_KEPT", 32)
    around = sweep._around
    monkeypatch.setattr(sweep, "_around", lambda result: kept.append(around(result)) or kept[-1])
    assert swept(spark) == whole and kept


def test_percentiles_elsewhere_are_found_all_the_same(spark, monkeypatch, whole):
    monkeypatch.setattr(sweep, "ALL_KEPT", 32)
    monkeypatch.setattr(sweep, "_around", lambda result: {(n, m): [(1000.0, 1001.0)] for n in queries.SIZES for m in sweep.MEASURES})
    assert swept(spark) == whole


def test_keys_sort_as_digests():
    rng = np.random.default_rng(1)
    x, y = np.concatenate([rng.uniform(-9, 9, 300), [4.2, 1e9]]), np.concatenate([rng.uniform(0, 4000, 300), [-0.00001, 0.0]])
    hashes = sweep.Hashes(x, y)
    for first, last in ((0, 12), (98, 103)):
        keys = hashes.keys(first, last)
        for k in range(first, last):
            text = [f"{k}:{math.floor(a * 10000)}:{math.floor(b * 10000)}" for a, b in zip(x, y)]
            assert keys[k - first].tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in text]


def test_keys_alike_are_told_apart_by_whole_digests():
    x = np.array([1.0, 1.00001, 2.0, 3.0])
    hashes, at = sweep.Hashes(x, x), np.arange(4)
    want = sorted(at, key=lambda i: (hashlib.md5(hashes.text(7, i).encode()).hexdigest(), x[i]))
    assert sweep.drawn(np.zeros((1, 4), np.uint64), 4, at, hashes, 7)[0].tolist() == want


def test_normals_of_planes_and_of_one_spot():
    pts = np.array([[0.0, 0, 0], [2, 0, 1], [0, 2, 0], [2, 2, 1], [5, 5, 5], [5, 5, 5], [5, 5, 5], [5, 5, 5]])
    hashes, keys = sweep.Hashes(pts[:, 0], pts[:, 1]), np.arange(8, dtype=np.uint64)[None] << np.uint64(60)
    one = [sweep.least_normals(np.array([4]), sweep._sums(pts, at, np.array([4]), keys, hashes, 0, np.empty(99)))[:, 0] for at in (np.arange(4), np.arange(4, 8))]
    assert np.allclose(one[0], np.array([-1, 0, 2]) / math.sqrt(5)) and np.isnan(one[1]).all()


def test_every_size_of_crowded_polygons_is_fitted_as_one_by_one():
    rng = np.random.default_rng(5)
    pts = rng.uniform(0, 8, (2500, 2))
    pts = np.column_stack([pts, 0.3 * pts[:, 0] - 0.1 * pts[:, 1] + rng.uniform(0, 1, 2500)])
    boxes, trials = {"a": (0.0, 0.0, 8.0, 8.0), "b": (1.0, 2.0, 6.0, 5.0), "c": (0.0, 0.0, 1.0, 1.0)}, 11
    table = pa.table(dict(zip("xyz", pts.T)))
    shape = pa.table({"polygon_id": list(boxes), "edges": pa.nulls(3), "true_azimuth": [10.0, 200.0, 300.0]} | dict(zip(("x0", "y0", "x1", "y1"), np.array(list(boxes.values())).T)))
    rows = {r["n"]: r for r in sweep._kernel("polygon_id", queries.SIZES, trials, 20, 0.15, {})(None, table, shape).to_pylist()}
    want: dict = {n: [] for n in queries.SIZES}
    for x0, y0, x1, y1 in boxes.values():
        own = pts[(pts[:, 0] > x0 + 0.15) & (pts[:, 0] < x1 - 0.15) & (pts[:, 1] > y0 + 0.15) & (pts[:, 1] < y1 - 0.15)]
        for k in range(trials):
            order = sorted(own.tolist(), key=lambda p: (hashlib.md5(f"{k}:{math.floor(p[0] * 10000)}:{math.floor(p[1] * 10000)}".encode()).hexdigest(), p))
            for n in queries.SIZES:
                if n <= len(own):
                    x, y, z = planes.pca_normal(np.array(order[:n]))[1]
                    want[n].append(math.degrees(math.atan2(math.hypot(x, y), z)))
    assert len(want[1000]) == trials and len(want[5]) == 3 * trials
    assert all(np.allclose(rows[n]["tilt_values"], sorted(t)) and rows[n]["trials"] == len(t) for n, t in want.items())
