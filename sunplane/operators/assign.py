"""Polygons to tiles: primary tiles, overlaps, tile groups, and which groups have their data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sunplane.functions import shapes

BOUNDS = ("x0", "y0", "x1", "y1")


def _tile_cells(tiles: DataFrame, size: float) -> DataFrame:
    return tiles.select(
        "tile_id", F.col("edges").alias("tile_edges"), _is_box().alias("tile_box"), *[F.col(k).alias("t" + k) for k in BOUNDS], F.explode(shapes.cells(*map(F.col, BOUNDS), size)).alias("cell")
    )


def _is_box() -> Column:
    return F.coalesce(shapes.is_box(F.col("edges"), *map(F.col, BOUNDS)), F.lit(False))


def primary_tiles(polygons: DataFrame, tiles: DataFrame, size: float = 1000.0) -> DataFrame:
    """(polygon_id, primary_tile_id): the tile that the centroid (cx, cy) lies strictly within, the least id of several.
    Polygons whose centroid is in none, or on a side, are left out. An equi-join on grid cells of `size`; the sides of upright rectangles aren't looked at."""
    at = polygons.select("polygon_id", "cx", "cy", shapes.cell(F.col("cx"), F.col("cy"), size).alias("cell"))
    cx, cy = F.col("cx"), F.col("cy")
    within = (cx > F.col("tx0")) & (cx < F.col("tx1")) & (cy > F.col("ty0")) & (cy < F.col("ty1"))
    hit = at.join(_tile_cells(tiles, size), "cell").filter(within & (F.col("tile_box") | shapes.eroded_contains(F.col("tile_edges"), cx, cy, 0.0)))
    return hit.groupBy("polygon_id").agg(F.min("tile_id").alias("primary_tile_id"))


def overlap_tiles(polygons: DataFrame, tiles: DataFrame, size: float = 1000.0) -> DataFrame:
    """(polygon_id, overlapping_tile_ids): the sorted ids of all tiles that the polygon intersects, touching included.
    Bounds come first; of upright rectangles they tell all."""
    at = polygons.select("polygon_id", "edges", _is_box().alias("box"), *BOUNDS, F.explode(shapes.cells(*map(F.col, BOUNDS), size)).alias("cell"))
    meet = (F.col("x0") <= F.col("tx1")) & (F.col("x1") >= F.col("tx0")) & (F.col("y0") <= F.col("ty1")) & (F.col("y1") >= F.col("ty0"))
    hit = at.join(_tile_cells(tiles, size), "cell").filter(meet & ((F.col("box") & F.col("tile_box")) | shapes.intersects(F.col("edges"), F.col("tile_edges"))))
    return hit.groupBy("polygon_id").agg(F.array_sort(F.collect_set("tile_id")).alias("overlapping_tile_ids"))


def assign(polygons: DataFrame, tiles: DataFrame, size: float = 1000.0) -> DataFrame:
    """(polygon_id, primary_tile_id, overlapping_tile_ids) for the polygons that have a primary tile."""
    return primary_tiles(polygons, tiles, size).join(overlap_tiles(polygons, tiles, size), "polygon_id", "left")


def tile_groups(assignments: DataFrame) -> DataFrame:
    """One row for each primary tile: its polygons, the tiles to fetch (all that any of them overlaps, and itself) and
    partition_id, its place among the primary tiles by id. The number of groups is at most the number of tiles,
    so one task orders them."""
    groups = assignments.groupBy("primary_tile_id").agg(
        F.array_sort(F.collect_set("polygon_id")).alias("polygon_ids"),
        F.flatten(F.collect_set(F.coalesce("overlapping_tile_ids", F.array().cast("array<string>")))).alias("fetched"),
    )
    return groups.select(
        "primary_tile_id",
        "polygon_ids",
        F.array_sort(F.array_union("fetched", F.array(F.col("primary_tile_id")))).alias("fetch_tile_ids"),
        (F.row_number().over(Window.orderBy("primary_tile_id")) - 1).cast("int").alias("partition_id"),
    )


def tiles_touched(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode("fetch_tile_ids").alias("tile_id")).distinct()


def with_data(groups: DataFrame, available: DataFrame) -> DataFrame:
    """Groups whose primary tile is available, fetching only tiles that are."""
    have = available.select("tile_id").distinct()
    kept = groups.join(have, F.col("primary_tile_id") == F.col("tile_id"), "left_semi")
    fetch = kept.select("primary_tile_id", F.explode("fetch_tile_ids").alias("tile_id")).join(have, "tile_id", "left_semi")
    lists = fetch.groupBy("primary_tile_id").agg(F.array_sort(F.collect_set("tile_id")).alias("fetch_tile_ids"))
    return kept.drop("fetch_tile_ids").join(lists, "primary_tile_id").select("primary_tile_id", "polygon_ids", "fetch_tile_ids", "partition_id")


def pending(groups: DataFrame, done: DataFrame) -> DataFrame:
    """Groups without a row of their partition_id in the output."""
    return groups.join(done.select("partition_id").distinct(), "partition_id", "left_anti")


def explode_parts(polygons: DataFrame, parts: str, order: str | list[str], explode: bool = True) -> DataFrame:
    """One row for each part of multi-part polygons: rings, parent_polygon_id, and polygon_id with `__p<n>`
    where the parent id has several rows, n counting in the order of `order` and then of the parts. Without `explode` the parts stay together and the parent is the id itself."""
    if not explode:
        return polygons.withColumn("parent_polygon_id", F.col("polygon_id"))
    rows = polygons.select("*", F.posexplode(parts).alias("_pos", "rings"))
    by = Window.partitionBy("polygon_id")
    nth = F.row_number().over(by.orderBy(*([order] if isinstance(order, str) else order), "_pos")) - 1
    many = F.count(F.lit(1)).over(by) > 1
    return (
        rows.withColumns({"_nth": nth, "_many": many, "parent_polygon_id": F.col("polygon_id")})
        .withColumn("polygon_id", F.when(F.col("_many"), F.concat("polygon_id", F.lit("__p"), F.col("_nth").cast("string"))).otherwise(F.col("polygon_id")))
        .drop("_nth", "_many")
    )


def in_box(polygons: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Polygons that intersect the box, touching included. The bounds test comes first and reaches the scan."""
    frame = shapes.edges(shapes.box_rings(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)))
    near = (F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1)
    return polygons.filter(near).filter(shapes.intersects(F.col("edges"), frame))


def of_score(rows: DataFrame, score: str, least: float, tiles: DataFrame, tile: str = "primary_tile_id") -> DataFrame:
    """The rows of a score of at least `least` whose tile is among `tiles` (tile_id). Null scores and tiles go."""
    return rows.filter(F.col(score) >= least).join(tiles.select(F.col("tile_id").alias("_wanted")), F.col(tile) == F.col("_wanted"), "left_semi")


def first_polygons(polygons: DataFrame, n: int, order: list[str]) -> DataFrame:
    return polygons.orderBy(*order).limit(n)
