"""Planar shapes as columns. `rings` is array<array<struct<x,y>>>, closed, the shell first and then the holes; `edges` is
array<struct<ax,ay,bx,by>>, the sides of all rings. Even-odd rule, so holes need no sense of rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunplane.functions.angles import let

RINGS = "array<array<struct<x:double,y:double>>>"
EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)))


def edges(rings: Column) -> Column:
    side = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), side)))


def _total(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def _ring_sums(ring: Column) -> Column:
    """Twice the signed area and six times its moments, about the ring's first corner."""
    o = F.get(ring, F.lit(0))
    sides = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct((a["x"] - o["x"]).alias("ax"), (a["y"] - o["y"]).alias("ay"), (b["x"] - o["x"]).alias("bx"), (b["y"] - o["y"]).alias("by")))
    c = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    return F.struct(_total(sides, c).alias("a"), _total(sides, lambda e: (e["ax"] + e["bx"]) * c(e)).alias("mx"), _total(sides, lambda e: (e["ay"] + e["by"]) * c(e)).alias("my"), o["x"].alias("ox"), o["y"].alias("oy"))


def measures(rings: Column) -> Column:
    """struct<area, cx, cy>: the shell's less the holes'; the centre is null if the area is 0."""
    parts = F.transform(rings, lambda r, i: F.struct(_ring_sums(r).alias("s"), F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign")))
    part_area = lambda p: p["sign"] * F.abs(p["s"]["a"]) / 2.0
    turned = lambda p, k: p["sign"] * F.signum(p["s"]["a"]) * p["s"][k] / 6.0
    area = _total(parts, part_area)
    at = lambda k, o: F.when(area > 0, _total(parts, lambda p: turned(p, k) + p["s"][o] * part_area(p)) / area)
    return F.struct(area.alias("area"), at("mx", "ox").alias("cx"), at("my", "oy").alias("cy"))


def bounds(rings: Column) -> Column:
    """struct<x0, y0, x1, y1>; nulls for an empty shape."""
    points = F.flatten(rings)
    pick = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(pick(F.array_min, "x").alias("x0"), pick(F.array_min, "y").alias("y0"), pick(F.array_max, "x").alias("x1"), pick(F.array_max, "y").alias("y1"))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside by the even-odd rule; points on a side may count either way, so ask
    boundary_distance too where that matters."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def boundary_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance from the nearest side; null without sides."""

    def square(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / size))).otherwise(F.lit(0.0))
        px, py = e["ax"] + t * dx - x, e["ay"] + t * dy - y
        return px * px + py * py

    return F.sqrt(F.array_min(F.transform(edges, square)))


def eroded_contains(edges: Column, x: Column, y: Column, erosion: float) -> Column:
    """Whether the point is strictly inside the shape shrunk by a disc of radius `erosion`."""
    return contains(edges, x, y) & (boundary_distance(edges, x, y) > erosion)


def intersects(a: Column, b: Column) -> Column:
    """Whether two shapes given by edges share a point, touching included."""
    turn = lambda ox, oy, px, py, qx, qy: F.signum((px - ox) * (qy - oy) - (py - oy) * (qx - ox))
    between = lambda e, x, y: (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"])) & (y >= F.least(e["ay"], e["by"])) & (y <= F.greatest(e["ay"], e["by"]))

    def meet(e: Column, f: Column) -> Column:
        d1, d2 = turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]), turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
        d3, d4 = turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]), turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
        proper = (d1 * d2 < 0) & (d3 * d4 < 0)
        touch = ((d1 == 0) & between(e, f["ax"], f["ay"])) | ((d2 == 0) & between(e, f["bx"], f["by"])) | ((d3 == 0) & between(f, e["ax"], e["ay"])) | ((d4 == 0) & between(f, e["bx"], e["by"]))
        return proper | touch

    first = lambda e: F.get(e, F.lit(0))
    return F.exists(a, lambda e: F.exists(b, lambda f: meet(e, f))) | contains(b, first(a)["ax"], first(a)["ay"]) | contains(a, first(b)["ax"], first(b)["ay"])


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The grid cells (struct<i, j>) that a box touches: the key of a spatial equi-join."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def cell(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("i"), F.floor(y / size).alias("j"))


def _key(i: Column, j: Column) -> Column:
    return F.shiftleft(i, 32) + j.bitwiseAND(F.lit((1 << 32) - 1))


def cell_key(x: Column, y: Column, size: float) -> Column:
    """The cell as one number, which sorts and hashes faster than a struct. Cells 2**32 rows apart share one, so compare bounds too."""
    return _key(F.floor(x / size), F.floor(y / size))


def by_cell(df: DataFrame, bounds: tuple[str, str, str, str], size: float) -> DataFrame:
    """df with a row for each cell that its bounds touch, as `cell`, the cell_key. Rows without bounds go."""
    x0, y0, x1, y1 = map(F.col, bounds)
    each = df.withColumn("_i", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size)))).withColumn("_j", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size))))
    return each.withColumn("cell", _key(F.col("_i"), F.col("_j"))).drop("_i", "_j")


def is_box(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the sides are just the four of the rectangle x0..y1."""

    def told(v: Column) -> Column:
        level = lambda e: (e["ay"] == e["by"]) & (F.least(e["ax"], e["bx"]) == v["x0"]) & (F.greatest(e["ax"], e["bx"]) == v["x1"])
        upright = lambda e: (e["ax"] == e["bx"]) & (F.least(e["ay"], e["by"]) == v["y0"]) & (F.greatest(e["ay"], e["by"]) == v["y1"])
        side = lambda e: F.when(level(e) & (e["ay"] == v["y0"]), 1).when(level(e) & (e["ay"] == v["y1"]), 2).when(upright(e) & (e["ax"] == v["x0"]), 4).when(upright(e) & (e["ax"] == v["x1"]), 8).otherwise(0)
        return (F.size(v["edges"]) == 4) & (v["x0"] < v["x1"]) & (v["y0"] < v["y1"]) & (F.aggregate(v["edges"], F.lit(0), lambda seen, e: seen.bitwiseOR(side(e))) == 15)

    return let({"edges": edges, "x0": x0, "y0": y0, "x1": x1, "y1": y1}, told)
