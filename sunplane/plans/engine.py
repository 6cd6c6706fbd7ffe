"""The whole run as one plan: polygons, points, footprints and tiles to output rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sunplane.config import Config
from sunplane.functions import shapes
from sunplane.functions.angles import height_over_plane, plane_angle
from sunplane.functions.kernels import boundary_distance, contains
from sunplane.operators import assign, planes, points as pt
from sunplane.operators.mounting import Classifier, RuleClassifier, is_tracker_suspected
from sunplane.schema import VERSION, conform
from sunplane.staging import staged


def with_measures(polygons: DataFrame) -> DataFrame:
    """polygons (with rings) plus edges, bounds, area, centroid and aspect_ratio. Empty shapes get nulls. Upright rectangles
    are told by their bounds; other shapes cross to Python for their aspect."""

    @F.pandas_udf("double")
    def aspect(rings):
        from sunplane.functions.kernels import aspect_ratio

        return rings.map(lambda rs: aspect_ratio([[(p["x"], p["y"]) for p in r] for r in rs] if rs is not None else None)).astype(float)

    out = polygons.withColumns({"edges": shapes.edges(F.col("rings")), "_b": shapes.bounds(F.col("rings"))}).withColumns({k: F.col(f"_b.{k}") for k in BOUNDS})
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = out.withColumn("_box", is_box() & (F.size("rings") == 1) & (w >= 1e-9) & (h >= 1e-9))
    out = out.withColumns({"_m": F.when(~F.col("_box"), shapes.measures(F.col("rings"))), "_ratio": aspect(F.when(~F.col("_box"), F.col("rings")))})
    told = {"area": w * h, "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "aspect_ratio": F.greatest(w, h) / F.least(w, h)}
    rest = {k: F.col(f"_m.{k}") for k in ("area", "cx", "cy")} | {"aspect_ratio": F.when(~F.isnan("_ratio"), F.col("_ratio"))}
    return out.withColumns({k: F.when(F.col("_box"), v).otherwise(rest[k]) for k, v in told.items()}).drop("_b", "_m", "_box", "_ratio")


BOUNDS = ("x0", "y0", "x1", "y1")


def is_box() -> Column:
    """Whether a shape of with_measures is the upright rectangle of its bounds."""
    return F.coalesce(shapes.is_box(F.col("edges"), *map(F.col, BOUNDS)), F.lit(False))


def _sides(edges: list[dict] | None) -> np.ndarray:
    return np.array([[e["ax"], e["ay"], e["bx"], e["by"]] for e in edges or []], float).reshape(-1, 4)


@dataclass
class Shape:
    """A polygon or building: its bounds, and its sides where it is no upright rectangle."""

    bounds: list[float]
    sides: np.ndarray | None

    def holds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = self.bounds
        return (x > x0) & (x < x1) & (y > y0) & (y < y1) if self.sides is None else contains(self.sides, x, y)

    def within(self, erosion: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which points lie in the shape shrunk by `erosion`."""
        x0, y0, x1, y1 = self.bounds
        if self.sides is None:
            return (x > x0 + erosion) & (x < x1 - erosion) & (y > y0 + erosion) & (y < y1 - erosion)
        return contains(self.sides, x, y) & (boundary_distance(self.sides, x, y) > erosion)

    def away(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The distance of points outside, 0 for the others."""
        x0, y0, x1, y1 = self.bounds
        if self.sides is None:
            dx, dy = np.maximum(np.maximum(x0 - x, x - x1), 0.0), np.maximum(np.maximum(y0 - y, y - y1), 0.0)
            return np.sqrt(dx * dx + dy * dy)
        return np.where(contains(self.sides, x, y), 0.0, boundary_distance(self.sides, x, y))


def _shapes(table: pa.Table, bounds: str, edges: str) -> list[Shape]:
    sides = [None if e is None else _sides(e) for e in table.column(edges).to_pylist()]
    corners = np.stack([table.column(bounds + k).to_numpy() for k in BOUNDS], axis=1).tolist()
    return [Shape(*c) for c in zip(corners, sides)]


def _median(v: np.ndarray) -> float:
    """np.median, without its checks."""
    half = len(v) // 2
    if len(v) % 2:
        return float(np.partition(v, half)[half])
    low, high = np.partition(v, (half - 1, half))[half - 1 : half + 1]
    return float((low + high) / 2)


def _measure_block(config: Config):
    """The kernel: the packed points of a block and its polygons to these polygons' fits and medians, in one pass. The points are
    put in order once, and each polygon looks only at a stretch of them."""
    reach, erosion, radius = config.roof_plane.buffer_max_m, config.panel_plane.erosion_m, config.heights.ground_search_radius_m
    c, r = config.panel_plane, config.roof_plane
    widths = pt.Buffers(r.buffer_m, r.buffer_max_m, r.buffer_step_m, r.min_points).widths

    def run(key: tuple, table: pa.Table, table_of_shapes: pa.Table) -> pa.Table:
        own = table_of_shapes.filter(table_of_shapes.column("own"))
        if not len(own):
            return FITS.empty_table()
        is_panel = table.column("is_panel")
        hits, soil = planes.in_order(pt.unpacked(table.filter(is_panel).column("data"))), pt.unpacked(table.filter(pc.invert(is_panel)).column("data"))
        x = np.ascontiguousarray(hits[:, 0])
        y = np.ascontiguousarray(hits[:, 1])
        stretch = lambda b, by: slice(*np.searchsorted(x, (b[0] - by, np.nextafter(b[2] + by, np.inf))))
        mine = _shapes(own, "", "edges")
        houses: dict = {}
        if r.enabled:
            idents = own.column("building_id").to_pylist()
            first = {b: k for k, b in reversed(list(enumerate(idents))) if b is not None}
            houses = dict(zip(first, _shapes(own.take(list(first.values())), "b", "building_edges"))) if first else {}
        free = np.ones(len(hits), bool)
        for shape in _shapes(table_of_shapes, "", "edges") if houses else ():
            at = stretch(shape.bounds, 0.0)
            free[at] &= ~shape.holds(x[at], y[at])
        roofs = {}
        for ident, house in houses.items():
            at = stretch(house.bounds, 0.0)
            roofs[ident] = at.start + np.flatnonzero(free[at] & house.holds(x[at], y[at]))
        ground: dict = {}
        rows = []
        columns = [own.column(k).to_pylist() for k in ("polygon_id", "cx", "cy", "building_id")]
        for shape, ident, cx, cy, building in zip(mine, *columns):
            at = stretch(shape.bounds, 0.0)
            pts = hits.take(at.start + np.flatnonzero(shape.within(erosion, x[at], y[at])), axis=0)
            seed = planes.stable_seed(ident)
            p = planes.fit_consensus(pts, c.ransac_threshold_m, c.min_inlier_frac, c.max_iter, c.tilt_floor_deg, seed)
            row = {"polygon_id": ident, "panel": planes.plane_row(p)}
            unc = planes.bootstrap(pts, p, c.bootstrap_samples, seed) if c.uncertainty_method == "bootstrap" else (math.nan, math.nan)
            row["tilt_unc"], row["azimuth_unc"] = (None if math.isnan(v) else v for v in unc)
            q = planes.second_plane(pts, p, config.multi_plane.secondary_min_frac, seed) if config.multi_plane.enabled else None
            row["second"] = planes.plane_row(q) if q else None
            if building in roofs:
                ring = roofs[building]
                ring = ring[slice(*np.searchsorted(ring, stretch(shape.bounds, reach).indices(len(x))[:2]))]
                away = shape.away(x[ring], y[ring])
                for width in widths:
                    near = (away > 0) & (away < width)
                    if np.count_nonzero(near) >= r.min_points:
                        roof = planes.fit_consensus(hits.take(ring[near], axis=0), r.ransac_threshold_m, seed=seed)
                        row |= {"buffer": width, "roof": planes.plane_row(roof)}
                        break
            top = pts[p.inliers] if p.n_inliers else pts
            if (cx, cy) not in ground:
                dx, dy = soil[:, 0] - cx, soil[:, 1] - cy
                below = soil[dx * dx + dy * dy <= radius * radius, 2]
                ground[cx, cy] = _median(below) if len(below) else None
            if len(top) and ground[cx, cy] is not None:
                row["hag"] = _median(top[:, 2]) - ground[cx, cy]
            if p.n_inliers:
                row["mx"], row["my"], row["mz"] = (_median(top[:, k]) for k in range(3))
            rows.append(row)
        return pa.Table.from_pylist(rows, FITS)

    return run


FITS = pa.schema(
    [("polygon_id", pa.string()), ("panel", planes.PLANE_TYPE), ("tilt_unc", pa.float64()), ("azimuth_unc", pa.float64()), ("second", planes.PLANE_TYPE), ("buffer", pa.float64()), ("roof", planes.PLANE_TYPE)]
    + [(k, pa.float64()) for k in ("hag", "mx", "my", "mz")]
)


def _fetched(points: DataFrame, groups: DataFrame) -> DataFrame:
    """The points of tiles that some group fetches."""
    return points.join(pt.small(assign.tiles_touched(groups)), "tile_id", "left_semi")


def survey(points: DataFrame, groups: DataFrame, config: Config = Config()) -> DataFrame:
    """What points.survey_tiles tells of the tiles that the groups fetch, staged."""
    return staged(pt.survey_tiles(_fetched(points, groups), config.io.classification.panel_class_primary), "survey")


def build_rows(
    points: DataFrame, polygons: DataFrame, footprints: DataFrame, tiles: DataFrame, config: Config = Config(), run_id: str = "", only: DataFrame | None = None, classifier: Classifier | None = None, surveyed: DataFrame | None = None
) -> DataFrame:
    """One output row for each polygon with a primary tile that has points.

    points: tile_id, x, y, z, cls. polygons: polygon_id, rings, optionally geometry (WKB). footprints:
    building_id, rings. tiles: tile_id, rings. only: partition_ids to restrict the run to (for resuming). classifier: what
    tells the mounting class; the configured rules if it is left out. surveyed: the survey, where one is at hand.

    The points are read twice, and only tiles that a group fetches (a table laid out by tile_id skips the others'
    files): once for the survey of classes by tile, which is staged, once for one join by grid cell and a few
    comparisons that give every block the points near its polygons. A third pass reads the ground points of those groups that lack the
    panels' class. Only points near polygons are shuffled, once to each block of neighbouring polygons and not once to each
    polygon, to one numpy kernel that tells panel from ring points and fits the planes. What is known of groups and polygons is
    staged, so that it is made once.
    """
    c = config
    shaped = with_measures(polygons)
    located = with_measures(tiles) if "edges" not in tiles.columns else tiles
    shaped = staged(shaped, "shapes")
    groups = assign.tile_groups(assign.assign(shaped, located, c.compute.tile_cell_size_m))
    if only is not None:
        groups = groups.join(only, "partition_id", "left_semi")
    groups = staged(groups, "groups")
    k = c.io.classification
    seen = survey(points, groups, c) if surveyed is None else surveyed
    groups = staged(assign.with_data(groups, seen), "groups")
    points = _fetched(points, groups)
    fetch = groups.select(F.col("primary_tile_id").alias("group"), F.explode("fetch_tile_ids").alias("tile_id"))
    choice = pt.class_choice(points, fetch, k.fallback_height_above_ground_m, k.panel_class_primary, k.panel_class_fallback, k.ground_class, seen)
    member = groups.select(F.col("primary_tile_id").alias("group"), "fetch_tile_ids", "partition_id", F.explode("polygon_ids").alias("polygon_id")).join(choice, "group")
    mine = shaped.join(member, "polygon_id")
    buildings = footprints if "edges" in footprints.columns else with_measures(footprints)
    reach = c.roof_plane.buffer_max_m
    mine = staged(mine, "polygons")
    buildings = mine.join(pt.pick_footprints(mine, buildings, c.compute.cell_size_m), "polygon_id", "left")
    side = lambda f, at: f(F.transform("building_edges", lambda e: e[at]))
    corners = {"bx0": side(F.array_min, "ax"), "by0": side(F.array_min, "ay"), "bx1": side(F.array_max, "ax"), "by1": side(F.array_max, "ay")}
    mine = staged(buildings.withColumns(corners), "polygons")

    house = F.coalesce(shapes.is_box(F.col("building_edges"), *map(F.col, corners)), F.lit(False))
    wanted = mine.select(
        "polygon_id", F.col("partition_id").alias("gid"), *BOUNDS, "cx", "cy", F.when(~is_box(), F.col("edges")).alias("edges"), "building_id", *corners, F.when(~house, F.col("building_edges")).alias("building_edges")
    )
    around, cells = pt.by_block(wanted, reach, c.heights.ground_search_radius_m)
    read = groups.select("partition_id", F.explode("fetch_tile_ids").alias("tile_id"), F.col("primary_tile_id").alias("group"))
    read = staged(read.join(choice, "group").select(F.col("partition_id").alias("gid"), "tile_id", "panel_class", "least_z"), "fetch")
    used = [row[0] for row in read.select("panel_class").distinct().collect()]
    near = pt.packed(pt.near_blocks(points, cells, read, used, k.ground_class))
    block = ["home", "gid", "part"]
    fits = near.groupBy(*block).cogroup(around.groupBy(*block)).applyInArrow(_measure_block(c), from_arrow_schema(FITS))
    return _rows(mine.join(fits, "polygon_id", "left"), c, run_id, classifier or RuleClassifier(c.mounting_rules.thresholds))


def _rows(joined: DataFrame, c: Config, run_id: str, classifier: Classifier) -> DataFrame:
    n_total, n_inliers = (F.coalesce(F.col(f"panel.{k}"), F.lit(0)) for k in ("n_total", "n_inliers"))
    on = F.col("building_id").isNotNull() if c.roof_plane.enabled else F.lit(False)
    available = F.coalesce(F.col("roof.tilt").isNotNull(), F.lit(False))
    hag = F.coalesce("hag", F.lit(0.0))
    har = F.when(available, height_over_plane(F.col("mx"), F.col("my"), F.col("mz"), F.col("roof")))
    angle = F.when(available, plane_angle(F.col("panel"), F.col("roof")))
    tilt, azimuth = F.col("panel.tilt"), F.col("panel.azimuth")
    rack = planes.is_east_west_rack(tilt, azimuth, F.col("second.tilt"), F.col("second.azimuth"), c.multi_plane.ew_rack_azimuth_tol_deg, c.multi_plane.ew_rack_tilt_tol_deg)
    complex_roof = F.col("roof").isNotNull() & (F.col("roof.tilt").isNull() | (F.col("roof.rmse") > c.roof_plane.rmse_max_m))
    flags = F.array_compact(
        F.array(
            F.when(pt.is_low_density(n_total, F.col("area"), c.panel_plane.min_density_pts_per_m2, c.panel_plane.min_points), F.lit("low_density")),
            F.when(tilt.isNull(), F.lit("poor_fit")).when(azimuth.isNull(), F.lit("near_horizontal")),
            F.when(rack, F.lit("east_west_rack")),
            F.when(on & F.col("roof").isNull(), F.lit("roof_insufficient")).when(on & complex_roof, F.lit("roof_complex")),
            F.when(is_tracker_suspected(on, F.col("aspect_ratio"), hag, F.coalesce(tilt, F.lit(0.0))), F.lit("tracker_suspected")),
        )
    )
    rows = joined.select("*", on.alias("on_building"), available.alias("roof_available"), hag.alias("height_above_ground_m"), har.alias("height_above_roof_m"), angle.alias("panel_roof_angle_deg"), flags.alias("flags"))
    features = {
        "on_building": F.col("on_building"),
        "roof_available": F.col("roof_available"),
        "tilt": tilt,
        "panel_roof_angle": F.col("panel_roof_angle_deg"),
        "height_above_roof": F.col("height_above_roof_m"),
        "height_above_ground": F.col("height_above_ground_m"),
        "aspect_ratio": F.col("aspect_ratio"),
    }
    rows = rows.withColumn("mount", classifier.classify(features))
    planes_found = F.when(F.col("second").isNotNull(), 2).when(tilt.isNotNull(), 1).otherwise(0)
    geometry = F.col("geometry") if "geometry" in joined.columns else _wkb()(F.col("rings"))
    return conform(
        rows.withColumns(
            {
                "geometry": geometry,
                "n_points_panel": n_total,
                "n_inliers_panel": n_inliers,
                "panel_tilt_deg": tilt,
                "panel_azimuth_deg": azimuth,
                "panel_rmse_m": F.col("panel.rmse"),
                "panel_tilt_unc_deg": F.col("tilt_unc"),
                "panel_azimuth_unc_deg": F.col("azimuth_unc"),
                "n_planes_detected": planes_found,
                "secondary_tilt_deg": F.col("second.tilt"),
                "secondary_azimuth_deg": F.col("second.azimuth"),
                "roof_tilt_deg": F.col("roof.tilt"),
                "roof_azimuth_deg": F.col("roof.azimuth"),
                "roof_rmse_m": F.col("roof.rmse"),
                "area_m2": F.col("area"),
                "mounting_type": F.col("mount.label"),
                "mounting_confidence": F.col("mount.confidence"),
                "mounting_rule": F.col("mount.rule"),
                "lidar_tile_ids": F.col("fetch_tile_ids"),
                "pkg_version": F.lit(VERSION),
                "config_hash": F.lit(c.hash),
                "run_id": F.lit(run_id),
            }
        )
    )


def _wkb():
    @F.arrow_udf("binary")
    def wkb(rings: pa.Array) -> pa.Array:
        from sunplane.functions.kernels import write_wkb_rings

        return write_wkb_rings(rings)

    return wkb
