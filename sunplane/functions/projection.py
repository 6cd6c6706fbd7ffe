"""Projections in closed form: transverse Mercator by Krueger's series (n^4), and slippy-map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunplane.functions.angles import let

# GRS80 / WGS84 and UTM.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH_SOUTH = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm_forward(lon: Column, lat: Column, zone: int, south: bool = False) -> list[Column]:
    """Easting and northing in metres."""

    def conformal(v: Column) -> Column:
        sine = F.sin(v["phi"])
        return let({"t": F.sinh(F.atanh(sine) - F.lit(_E) * F.atanh(F.lit(_E) * sine)), "lam": v["lam"]}, sphere)

    def sphere(v: Column) -> Column:
        c = F.cos(v["lam"])
        return let({"xi": F.atan2(v["t"], c), "eta": F.asinh(F.sin(v["lam"]) / F.sqrt(v["t"] * v["t"] + c * c))}, plane)

    def plane(v: Column) -> Column:
        east, north = v["eta"], v["xi"]
        for k, a in enumerate(_ALPHA, 1):
            east = east + F.lit(a) * F.cos(F.lit(2.0 * k) * v["xi"]) * F.sinh(F.lit(2.0 * k) * v["eta"])
            north = north + F.lit(a) * F.sin(F.lit(2.0 * k) * v["xi"]) * F.cosh(F.lit(2.0 * k) * v["eta"])
        return F.struct((F.lit(FALSE_EAST) + F.lit(SCALE * _RADIUS) * east).alias("x"), (F.lit(FALSE_NORTH_SOUTH if south else 0.0) + F.lit(SCALE * _RADIUS) * north).alias("y"))

    out = let({"phi": F.radians(lat), "lam": F.radians(lon) - F.lit(math.radians(6 * zone - 183))}, conformal)
    return [out["x"], out["y"]]


def utm_inverse(east: Column, north: Column, zone: int, south: bool = False) -> list[Column]:
    """Longitude and latitude in degrees."""

    def sphere(v: Column) -> Column:
        x, e = v["xi"], v["eta"]
        for k, b in enumerate(_BETA, 1):
            x = x - F.lit(b) * F.sin(F.lit(2.0 * k) * v["xi"]) * F.cosh(F.lit(2.0 * k) * v["eta"])
            e = e - F.lit(b) * F.cos(F.lit(2.0 * k) * v["xi"]) * F.sinh(F.lit(2.0 * k) * v["eta"])
        return let({"x": x, "e": e}, start)

    def start(v: Column) -> Column:
        t = F.sin(v["x"]) / F.sqrt(F.sinh(v["e"]) * F.sinh(v["e"]) + F.cos(v["x"]) * F.cos(v["x"]))
        return let({"t1": t, "tau": t, "lon": F.atan2(F.sinh(v["e"]), F.cos(v["x"]))}, lambda w: newton(w, 3))

    def newton(v: Column, left: int) -> Column:
        """Steps back from the conformal latitude."""
        if not left:
            return F.struct((F.degrees(v["lon"]) + F.lit(6.0 * zone - 183)).alias("x"), F.degrees(F.atan(v["tau"])).alias("y"))
        tau, root = v["tau"], F.sqrt(F.lit(1.0) + v["tau"] * v["tau"])
        sigma = F.sinh(F.lit(_E) * F.atanh(F.lit(_E) * tau / root))
        return let({"t1": v["t1"], "tau": tau, "lon": v["lon"], "root": root, "now": tau * F.sqrt(F.lit(1.0) + sigma * sigma) - sigma * root}, lambda w: step(w, left))

    def step(v: Column, left: int) -> Column:
        tau, now = v["tau"], v["now"]
        slope = F.sqrt(F.lit(1.0) + now * now) * v["root"] * F.lit(1 - _E**2) / (F.lit(1.0) + F.lit(1 - _E**2) * tau * tau)
        return let({"t1": v["t1"], "tau": tau + (v["t1"] - now) / slope, "lon": v["lon"]}, lambda w: newton(w, left - 1))

    out = let({"xi": (north - F.lit(FALSE_NORTH_SOUTH if south else 0.0)) / F.lit(SCALE * _RADIUS), "eta": (east - F.lit(FALSE_EAST)) / F.lit(SCALE * _RADIUS)}, sphere)
    return [out["x"], out["y"]]


def slippy_tile(lon: Column, lat: Column, zoom: int) -> list[Column]:
    """Column and row of the Web-Mercator tile."""
    n = F.lit(float(2**zoom))
    return [F.floor((lon + 180.0) / 360.0 * n), F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi)) / 2.0 * n)]


def slippy_corner(column: Column, row: Column, zoom: int) -> list[Column]:
    """Longitude and latitude of a tile's north-west corner."""
    n = F.lit(float(2**zoom))
    return [column / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * row / n))))]
