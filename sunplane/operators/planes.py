"""Plane fits: least squares as an aggregate, and consensus fits, bootstrap and second planes as one numpy kernel.

Random choices come from a linear congruential generator over a stable seed, so a fit is the same whatever the
partitions, the workers or the engine; points are taken in the order of (x, y, z).
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from sunplane.functions import shapes
from sunplane.functions.angles import azimuth, least_variance_normal, tilt
from sunplane.functions.kernels import boundary_distance, contains
from sunplane.operators.points import by_home

# The generator.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31
ITERATION_STEP, DRAW_STEP = 1000003, 7919
MULTI_THRESHOLD, MULTI_FRACTION, MULTI_ITERATIONS = 0.10, 0.5, 200


def scramble(state: np.ndarray) -> np.ndarray:
    """One step of the generator between two shifts, so that states in a row don't lie on a lattice. States are from 0 up, so
    masks and shifts are remainders and quotients."""
    out = state >> 15
    out ^= state
    out *= LCG_A
    out += LCG_C
    out &= LCG_M - 1
    out ^= out >> 13
    return out


def triples(seed: int, n: int, iterations: int) -> np.ndarray:
    """(iterations, 3) different indices below n: the k-th draw picks among those that are left, in order."""
    s = (seed + ITERATION_STEP * np.arange(iterations, dtype=np.int64)) % LCG_M
    r1 = scramble(s)
    r2 = scramble(r1)
    r3 = scramble(r2)
    i = (r1 >> 8) % n
    j = (r2 >> 8) % (n - 1)
    j += j >= i
    k = (r3 >> 8) % (n - 2)
    k += k >= np.minimum(i, j)
    k += k >= np.maximum(i, j)
    return np.stack([i, j, k], axis=1)


@dataclass
class Plane:
    normal: np.ndarray
    centroid: np.ndarray
    tilt: float
    azimuth: float
    rmse: float
    n_inliers: int
    n_total: int
    inliers: np.ndarray


def failed(n: int) -> Plane:
    return Plane(np.array([0.0, 0.0, 1.0]), np.zeros(3), math.nan, math.nan, math.nan, 0, n, np.zeros(n, bool))


def tilt_azimuth(normal: np.ndarray, floor: float = 1.0) -> tuple[float, float]:
    x, y, z = normal if normal[2] >= 0 else -normal
    t = math.degrees(math.atan2(math.hypot(x, y), z))
    return t, math.degrees(math.atan2(x, y)) % 360.0 if t >= floor else math.nan


def pca_normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and unit normal, upward, of the least-squares plane."""
    d = np.ascontiguousarray(points.T)
    centre = d.mean(axis=1)
    d -= centre[:, None]
    v = np.linalg.eigh(d @ d.T)[1][:, 0]
    return centre, v if v[2] >= 0 else -v


def _distances(points: np.ndarray, at: np.ndarray, normals: np.ndarray) -> np.ndarray:
    d = [points[None, :, k] - at[:, None, k] for k in range(3)]
    return np.abs(d[0] * normals[:, None, 0] + d[1] * normals[:, None, 1] + d[2] * normals[:, None, 2])


def _first_best(pts: np.ndarray, at: np.ndarray, normals: np.ndarray, threshold: float) -> int:
    """The first of the planes (a point and a normal each) with the most points nearer than the threshold. Single-precision
    products bound each count from above; exact distances tell those that may be the most, from the highest bound on. A plane
    with all points ends the search, as none has more."""
    n = len(pts)
    columns = np.ascontiguousarray(pts.T)
    low, high = columns.min(axis=1), columns.max(axis=1)
    centre = (low + high) / 2
    start = at - centre
    margin = 4e-6 * (4 * np.maximum(high - centre, centre - low).max() + threshold)  # ten times what rounding of the products and sums can add up to
    if not margin < 1e30:
        return int(np.argmax([(_distances(pts, at[k : k + 1], normals[k : k + 1]) < threshold).sum() for k in range(len(at))]))
    planes = np.concatenate([normals, -(normals * start).sum(axis=1, keepdims=True)], axis=1).astype(np.float32)
    flat = np.ones((4, n), np.float32)
    np.subtract(columns, centre[:, None], out=flat[:3], casting="same_kind")
    most, best, least, k, step = np.float32(threshold + margin), len(planes), -1, 0, 16
    while k < len(planes) and least < n:
        d = planes[k : k + step] @ flat
        np.abs(d, out=d)
        upper = np.bitwise_count(np.packbits(d < most, axis=1)).sum(axis=1, dtype=np.int64)
        for i in np.argsort(-upper, kind="stable").tolist():
            if upper[i] < least or upper[i] == least and k + i > best:
                break
            count = int(np.count_nonzero(_distances(pts, at[k + i : k + i + 1], normals[k + i : k + i + 1]) < threshold))
            if count > least or count == least and k + i < best:
                best, least = k + i, count
        k, step = k + step, max(1, min(256, 50_000 // n))
    return best


def fit_all(points: np.ndarray, tilt_floor: float = 1.0) -> Plane:
    """The least-squares plane of all points, which all count as inliers. Fewer than 3 points are a failed fit."""
    if len(points) < 3:
        return failed(len(points))
    centre, normal = pca_normal(points)
    return Plane(normal, centre, *tilt_azimuth(normal, tilt_floor), float(np.sqrt(np.mean(((points - centre) @ normal) ** 2))), len(points), len(points), np.ones(len(points), bool))


def fit_consensus(
    points: np.ndarray, threshold: float = 0.05, least_fraction: float = 0.6, iterations: int = 200, tilt_floor: float = 1.0, seed: int = 0, picks: np.ndarray | None = None, all_points: bool = False
) -> Plane:
    """The consensus plane (see _fit_consensus). With all_points, the least-squares plane of all points where its share of
    inliers is under least_fraction or the fit fails."""
    plane = _fit_consensus(points, threshold, least_fraction, iterations, tilt_floor, seed, picks)
    return fit_all(np.asarray(points, float), tilt_floor) if all_points and plane.n_inliers < max(3, least_fraction * plane.n_total) else plane


def _fit_consensus(points: np.ndarray, threshold: float, least_fraction: float, iterations: int, tilt_floor: float, seed: int, picks: np.ndarray | None) -> Plane:
    """The plane with the most points nearer than the threshold among those through `iterations` triples, the first of
    equals; refitted by least squares to these, its inliers then named anew. Fewer than 3 points or inliers is
    a failed fit; a share of inliers under `least_fraction` leaves tilt and azimuth undefined. `picks` replaces the
    generator's triples."""
    pts = np.asarray(points, float)
    if pts.ndim != 2 or pts.shape[1] != 3:
        raise ValueError(f"points are (n, 3), not {pts.shape}")
    n = len(pts)
    if n < 3:
        return failed(n)
    picks = triples(seed, n, iterations) if picks is None else picks
    p0, p1, p2 = pts[picks.T]
    (ux, uy, uz), (vx, vy, vz) = np.ascontiguousarray((p1 - p0).T), np.ascontiguousarray((p2 - p0).T)
    cx, cy, cz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    cross, size = np.stack([cx, cy, cz], axis=1), np.sqrt(cx * cx + cy * cy + cz * cz)
    good = np.flatnonzero(size >= 1e-9)
    if not len(good):
        return failed(n)
    normals = cross[good] / size[good][:, None]
    best = _first_best(pts, p0[good], normals, threshold)
    inside = _distances(pts, p0[good[best : best + 1]], normals[best : best + 1])[0] < threshold
    if inside.sum() < 3:
        return failed(n)
    centre, normal = pca_normal(pts[inside])
    inside = _distances(pts, centre[None], normal[None])[0] < threshold
    count = int(inside.sum())
    if count < 3:
        return failed(n)
    rmse = float(np.sqrt(np.mean(((pts[inside] - centre) @ normal) ** 2)))
    t, a = tilt_azimuth(normal, tilt_floor) if count / n >= least_fraction else (math.nan, math.nan)
    return Plane(normal, centre, t, a, rmse, count, n, inside)


def bootstrap(points: np.ndarray, plane: Plane, samples: int = 50, seed: int = 0) -> tuple[float, float]:
    """One standard deviation of tilt, and one circular one of azimuth, over refits to resampled inliers. How often each inlier is
    drawn tells a resample's moments, so it isn't written out."""
    pts = points[plane.inliers]
    n = len(pts)
    if n < 3:
        return math.nan, math.nan
    if samples < 2:
        return math.nan, math.nan
    draw, rep = DRAW_STEP * np.arange(1, n + 1, dtype=np.int64), ITERATION_STEP * np.arange(1, samples + 1, dtype=np.int64)[:, None] + seed
    draw, rep = (draw & (LCG_M - 1)).astype(np.uint32), (rep & (LCG_M - 1)).astype(np.uint32)  # the generator needs no more bits
    x, y, z = np.ascontiguousarray(pts.T) - pts.T.mean(axis=1, keepdims=True)
    terms = np.stack([x, y, z, x * x, x * y, x * z, y * y, y * z, z * z], axis=1)
    sums = []
    step = max(1, 1_000_000 // n)
    for k in range(0, samples, step):
        at = scramble(scramble((rep[k : k + step] + draw) & np.uint32(LCG_M - 1))) >> np.uint32(8)
        at -= at // np.uint32(n) * np.uint32(n)
        at = at.astype(np.int64) + n * np.arange(len(at))[:, None]
        sums.append(np.bincount(at.ravel(), minlength=at.size).astype(float).reshape(at.shape) @ terms)
    mean = np.concatenate(sums) / n
    centre, spread = mean[:, :3], mean[:, [3, 4, 5, 4, 6, 7, 5, 7, 8]].reshape(-1, 3, 3)
    v = np.linalg.eigh(spread - centre[:, :, None] * centre[:, None])[1][:, :, 0]
    v *= np.where(v[:, 2:] < 0, -1.0, 1.0)
    tilts, turn = np.degrees(np.arctan2(np.hypot(v[:, 0], v[:, 1]), v[:, 2])), np.arctan2(v[:, 0], v[:, 1])
    r = min(1.0, math.hypot(float(np.cos(turn).mean()), float(np.sin(turn).mean())))
    return float(np.std(tilts, ddof=1)), math.degrees(math.sqrt(-2.0 * math.log(r))) if r > 0 else math.nan


def second_plane(points: np.ndarray, first: Plane, least_share: float = 0.20, seed: int = 0, iterations: int = MULTI_ITERATIONS) -> Plane | None:
    """A plane among the points that are no inliers of the first, if it has enough of them."""
    if first.n_inliers < 10 or math.isnan(first.tilt):
        return None
    rest = points[~first.inliers]
    least = max(round(least_share * first.n_total), 10)
    if len(rest) < least:
        return None
    plane = fit_consensus(rest, MULTI_THRESHOLD, MULTI_FRACTION, iterations, seed=seed)
    return None if plane.n_inliers < least or math.isnan(plane.tilt) else plane


def is_east_west_rack(tilt1: Column, azimuth1: Column, tilt2: Column, azimuth2: Column, azimuth_tol: float = 25.0, tilt_tol: float = 5.0) -> Column:
    """Two planes of like tilt that face opposite ways; false where an azimuth is undefined."""
    off = azimuth1 - azimuth2
    off = off - F.lit(360.0) * F.floor(off / F.lit(360.0))
    return F.coalesce((F.abs(off - F.lit(180.0)) < azimuth_tol) & (F.abs(tilt1 - tilt2) < tilt_tol), F.lit(False))


def in_order(points: np.ndarray) -> np.ndarray:
    """Points by x, y, z: the order that draws refer to."""
    return points[np.lexsort(points.T[::-1])]


PLANE_NAMES = ("nx", "ny", "nz", "cx", "cy", "cz", "tilt", "azimuth", "rmse", "n_inliers", "n_total")
PLANE_TYPE = pa.struct([(k, pa.int32() if k.startswith("n_") else pa.float64()) for k in PLANE_NAMES])


def plane_row(p: Plane) -> dict:
    """The plane as a row: undefined numbers are null, and so are a failed fit's normal and centroid."""
    some = lambda v: None if v is None or math.isnan(v) else float(v)
    vectors = dict(zip(("nx", "ny", "nz", "cx", "cy", "cz"), [*p.normal, *p.centroid])) if p.n_inliers else dict.fromkeys(("nx", "ny", "nz", "cx", "cy", "cz"))
    return {k: some(v) for k, v in vectors.items()} | {"tilt": some(p.tilt), "azimuth": some(p.azimuth), "rmse": some(p.rmse), "n_inliers": p.n_inliers, "n_total": p.n_total}


def fit_groups(points: DataFrame, key: str, threshold: float = 0.05, least_fraction: float = 0.6, iterations: int = 200, tilt_floor: float = 1.0, samples: int = 0, second: bool = False, sampler: str = "lcg", all_points: bool = False) -> DataFrame:
    """One row for each key of points (key, x, y, z): the consensus plane's fields, with `samples` tilt_unc and
    azimuth_unc, with `second` the second plane's tilt2, azimuth2 and n_inliers2 (null if there is none).

    Points cross to Python once. A group is one polygon's clipped points, thousands at most by its area and the
    sensor's density, so it fits in a task. sampler `numpy` draws with numpy's generator instead; all_points: as in fit_consensus. Null keys form one group;
    points with a null coordinate are left out; no points, no row.
    """
    arrow = _fit_schema(points, key, samples, second)

    def fit(k: tuple, table: pa.Table) -> pa.Table:
        pts = in_order(np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1))
        return pa.Table.from_pylist([_fit_row(key, k[0].as_py(), pts, threshold, least_fraction, iterations, tilt_floor, samples, second, sampler, all_points)], arrow)

    return points.select(key, "x", "y", "z").groupBy(key).applyInArrow(fit, from_arrow_schema(arrow))


def _fit_schema(df: DataFrame, key: str, samples: int, second: bool) -> pa.Schema:
    number, count = pa.float64(), pa.int32()
    fields = [(k, count if k.startswith("n_") else number) for k in PLANE_NAMES]
    fields += [("tilt_unc", number), ("azimuth_unc", number)] * bool(samples) + [("tilt2", number), ("azimuth2", number), ("n_inliers2", count)] * second
    return pa.schema([to_arrow_schema(df.select(key).schema).field(0), *[pa.field(*f) for f in fields]])


def _fit_row(key: str, ident, pts: np.ndarray, threshold: float, least_fraction: float, iterations: int, tilt_floor: float, samples: int, second: bool, sampler: str = "lcg", all_points: bool = False) -> dict:
    """fit_groups' row of one group, its points in order."""
    pts = pts[~np.isnan(pts).any(axis=1)]
    seed = stable_seed(ident)
    picks = None
    if sampler == "numpy" and len(pts) >= 3:
        rng = np.random.default_rng(seed)
        picks = np.stack([rng.choice(len(pts), 3, replace=False) for _ in range(iterations)])
    p = fit_consensus(pts, threshold, least_fraction, iterations, tilt_floor, seed, picks, all_points)
    row = {key: ident} | plane_row(p)
    if samples:
        row["tilt_unc"], row["azimuth_unc"] = (None if math.isnan(v) else v for v in bootstrap(pts, p, samples, seed))
    if second:
        q = second_plane(pts, p, seed=seed, iterations=iterations)
        q = plane_row(q) if q else {}
        row |= {"tilt2": q.get("tilt"), "azimuth2": q.get("azimuth"), "n_inliers2": q.get("n_inliers")}
    return row


def fit_clipped(points: DataFrame, polygons: DataFrame, key: str = "polygon_id", erosion: float = 0.15, threshold: float = 0.05, least_fraction: float = 0.6, iterations: int = 200, tilt_floor: float = 1.0, samples: int = 0) -> DataFrame:
    """fit_groups of what clip gives of points and polygons (key, edges, x0..y1), without a row for each pair of them: polygons
    near each other share one group with the points around them, which cross to Python once, in order, and are clipped there."""
    arrow = _fit_schema(polygons, key, samples, False)
    box = F.coalesce(shapes.is_box(F.col("edges"), *map(F.col, ("x0", "y0", "x1", "y1"))), F.lit(False))
    told = polygons.select(key, "x0", "y0", "x1", "y1", F.when(~box, F.col("edges")).alias("edges"))
    dealt, housed = by_home(points.select("x", "y", "z"), told, key)

    def fit(k: tuple, table: pa.Table, shape: pa.Table) -> pa.Table:
        pts = in_order(np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1))
        x, y = pts[:, 0], pts[:, 1]
        parts: dict = {}
        for i, (ident, edges) in enumerate(zip(shape.column(key).to_pylist(), shape.column("edges").to_pylist())):
            parts.setdefault(ident, []).append((i, edges))
        bounds = np.stack([shape.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
        rows = []
        for ident, own in parts.items():
            inside = [np.flatnonzero(clips(bounds[i], edges, erosion, x, y)) for i, edges in own]
            at = inside[0] if len(own) == 1 else np.sort(np.concatenate(inside))
            if len(at):
                rows.append(_fit_row(key, ident, pts[at], threshold, least_fraction, iterations, tilt_floor, samples, False))
        return pa.Table.from_pylist(rows, arrow)

    return dealt.groupBy("home", "part").cogroup(housed.groupBy("home", "part")).applyInArrow(fit, from_arrow_schema(arrow))


def clips(bounds: np.ndarray, edges: list[dict] | None, erosion: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points clip keeps; edges is None for an upright rectangle."""
    x0, y0, x1, y1 = bounds
    if edges is None:
        return (x > x0 + erosion) & (x < x1 - erosion) & (y > y0 + erosion) & (y < y1 - erosion)
    sides = np.array([[e["ax"], e["ay"], e["bx"], e["by"]] for e in edges], float).reshape(-1, 4)
    near = np.flatnonzero((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
    out = np.zeros(len(x), bool)
    if len(sides) and len(near):
        out[near] = contains(sides, x[near], y[near]) & (boundary_distance(sides, x[near], y[near]) > erosion)
    return out


def stable_seed(ident) -> int:
    return int(hashlib.md5(str(ident).encode()).hexdigest()[:7], 16)


def fit_least_squares(points: DataFrame, keys: list[str], tilt_floor: float = 1.0) -> DataFrame:
    """One row for each key: n, the centroid, the normal, tilt and azimuth of the least-squares plane, and rmse, the root
    mean square of the points' residuals, all from moments in one map-side aggregate. Under 3 points, or all in one spot, the
    plane is null."""
    m = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias("c" + c) for c in "xyz"],
        *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")],
    )
    spread = (F.col("n") >= 3) & (F.col("xx") + F.col("yy") + F.col("zz") > 0)
    normal = least_variance_normal({c: F.when(spread, F.col(c)) for c in ("xx", "xy", "xz", "yy", "yz", "zz")})
    moments = [a + b for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    out = m.select(*keys, "n", "cx", "cy", "cz", *moments, normal.alias("normal")).select(*keys, "n", "cx", "cy", "cz", *moments, *[F.col(f"normal.{k}").alias("n" + k) for k in "xyz"])
    square = sum((F.col("n" + a) * F.col("n" + b) * F.col(a + b) * (1.0 if a == b else 2.0) for a, b in moments), F.lit(0.0))
    out = out.withColumn("rmse", F.sqrt(F.greatest(square, F.lit(0.0)))).drop(*moments)
    vector = [F.col("nx"), F.col("ny"), F.col("nz")]
    return out.withColumns({"tilt": tilt(*vector), "azimuth": azimuth(*vector, tilt_floor)})
