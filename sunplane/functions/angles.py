"""Plane angles and heights. x is east, y north, z up; azimuth is degrees clockwise from north. Undefined is null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap360(degrees: Column) -> Column:
    return degrees - F.lit(360.0) * F.floor(degrees / F.lit(360.0))


def tilt(nx: Column, ny: Column, nz: Column) -> Column:
    """Degrees between the normal, whichever way it points, and the vertical."""
    return F.degrees(F.atan2(F.hypot(nx, ny), F.abs(nz)))


def azimuth(nx: Column, ny: Column, nz: Column, tilt_floor: float = 1.0) -> Column:
    """Compass direction of the upward normal; null where the tilt is under the floor."""
    up = F.when(nz < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(tilt(nx, ny, nz) >= tilt_floor, wrap360(F.degrees(F.atan2(up * nx, up * ny))))


def azimuth_difference(a: Column, b: Column) -> Column:
    """a - b in [-180, 180)."""
    return wrap360(a - b + F.lit(180.0)) - F.lit(180.0)


def residual(x: Column, y: Column, z: Column, plane: Column) -> Column:
    """Signed distance of a point from a plane with fields cx, cy, cz, nx, ny, nz."""
    return (x - plane["cx"]) * plane["nx"] + (y - plane["cy"]) * plane["ny"] + (z - plane["cz"]) * plane["nz"]


def plane_angle(a: Column, b: Column) -> Column:
    """Degrees between two planes' normals; null if either has under 3 inliers or no tilt."""
    dot = a["nx"] * b["nx"] + a["ny"] * b["ny"] + a["nz"] * b["nz"]
    usable = (a["n_inliers"] >= 3) & (b["n_inliers"] >= 3) & a["tilt"].isNotNull() & b["tilt"].isNotNull()
    return F.when(usable, F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))))


def height_over_plane(x: Column, y: Column, z: Column, plane: Column) -> Column:
    """z less the plane's height at (x, y); null without a usable plane or if it is vertical."""
    usable = (plane["n_inliers"] >= 3) & plane["tilt"].isNotNull() & (F.abs(plane["nz"]) >= 1e-9)
    at = plane["cz"] - (plane["nx"] * (x - plane["cx"]) + plane["ny"] * (y - plane["cy"])) / plane["nz"]
    return F.when(usable, z - at)


def circular_std(azimuths_sin_mean: Column, azimuths_cos_mean: Column) -> Column:
    """Mardia's circular standard deviation in degrees from the mean sine and cosine; null if the mean vector is 0."""
    r = F.least(F.hypot(azimuths_sin_mean, azimuths_cos_mean), F.lit(1.0))
    return F.when(r > 0, F.degrees(F.sqrt(F.lit(-2.0) * F.ln(r))))


def let(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """use(struct of the values), each value computed once however often it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), F.lit(0))


def least_variance_normal(moments: dict[str, Column]) -> Column:
    """struct<x, y, z>: the unit eigenvector, z upward, of the least eigenvalue of a covariance matrix given as xx, xy, xz,
    yy, yz, zz, in closed form: the cosine solution of the characteristic cubic, then the longest cross product of
    two rows of A - lambda I. Null if the matrix is null or a multiple of the unit matrix."""

    def scale(m: Column) -> Column:
        q = (m["xx"] + m["yy"] + m["zz"]) / 3.0
        return let({k: m[k] for k in ("xx", "xy", "xz", "yy", "yz", "zz")} | {"q": q}, spread)

    def spread(m: Column) -> Column:
        a, d, f = m["xx"] - m["q"], m["yy"] - m["q"], m["zz"] - m["q"]
        p = F.sqrt((a * a + d * d + f * f + F.lit(2.0) * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])) / 6.0)
        return let({k: m[k] for k in ("xx", "xy", "xz", "yy", "yz", "zz", "q")} | {"p": F.when(p > 0, p)}, root)

    def root(m: Column) -> Column:
        a, b, c, d, e, f = (m["xx"] - m["q"]) / m["p"], m["xy"] / m["p"], m["xz"] / m["p"], (m["yy"] - m["q"]) / m["p"], m["yz"] / m["p"], (m["zz"] - m["q"]) / m["p"]
        half = (a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)) / 2.0
        least = m["q"] + F.lit(2.0) * m["p"] * F.cos(F.acos(F.greatest(F.least(half, F.lit(1.0)), F.lit(-1.0))) / 3.0 + F.lit(2 * math.pi / 3))
        return let({k: m[k] for k in ("xx", "xy", "xz", "yy", "yz", "zz")} | {"l": least}, crosses)

    def crosses(m: Column) -> Column:
        r = [(m["xx"] - m["l"], m["xy"], m["xz"]), (m["xy"], m["yy"] - m["l"], m["yz"]), (m["xz"], m["yz"], m["zz"] - m["l"])]
        cross = lambda u, v: {"x": u[1] * v[2] - u[2] * v[1], "y": u[2] * v[0] - u[0] * v[2], "z": u[0] * v[1] - u[1] * v[0]}
        sized = lambda o: let(cross(*o), lambda v: F.struct((v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]).alias("size"), v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z")))
        return let({"best": F.array_max(F.array(*[sized(o) for o in ((r[0], r[1]), (r[0], r[2]), (r[1], r[2]))]))}, unit)

    def unit(m: Column) -> Column:
        b = m["best"]
        length = F.sqrt(b["size"]) * F.when(b["z"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.when(b["size"] > 0, F.struct(*[(b[k] / length).alias(k) for k in "xyz"]))

    return let(moments, scale)
