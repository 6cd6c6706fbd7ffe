"""Identifiers, tile names and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunplane.staging import numbered

# Right-closed bounds of the area bins, in square metres.
AREA_BINS = (0.0, 5.0, 15.0, 40.0, 80.0, 250.0)
FEET_TO_METRES = 0.3048


def with_polygon_id(df: DataFrame) -> DataFrame:
    """polygon_id as text, from polygon_id or else detection_id; ValueError without either."""
    have = {c.lower(): c for c in df.columns}
    source = have.get("polygon_id") or have.get("detection_id")
    if source is None:
        raise ValueError("a polygon table needs a polygon_id or a detection_id column")
    return df.withColumn("polygon_id", F.col(source).cast("string"))


def with_building_id(df: DataFrame, order: list[str] | None = None, id_col: str | None = None) -> DataFrame:
    """building_id as text: from id_col, building_id or build_id, or else auto_<n>, numbered from 0 by `order`."""
    have = {c.lower(): c for c in df.columns}
    source = (id_col and have.get(id_col.lower())) or have.get("building_id") or have.get("build_id")
    if source:
        return df.withColumn("building_id", F.col(source).cast("string"))
    if not order:
        raise ValueError("a footprint table without ids needs an order to number its rows by")
    return numbered(df, order, "_place").withColumn("building_id", F.concat(F.lit("auto_"), F.col("_place").cast("string"))).drop("_place")


def tile_uri(base: str, template: str, name: Column) -> Column:
    """base without trailing slashes, a slash, and the template with {name} filled in."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.lit(template), F.lit("{name}"), name))


def km_tile_name(x: Column, y: Column) -> Column:
    """w0432n3719: whole kilometres of a point, four digits each."""
    part = lambda v: F.lpad(F.floor(v / 1000).cast("string"), 4, "0")
    return F.concat(F.lit("w"), part(x), F.lit("n"), part(y))


def area_bin(area: Column) -> Column:
    """The right-closed bin of AREA_BINS as `(low, high]`; null outside."""
    out = F.lit(None).cast("string")
    for low, high in zip(AREA_BINS[:-1], AREA_BINS[1:]):
        out = F.when((area > low) & (area <= high), F.lit(f"({low:g}, {high:g}]")).otherwise(out)
    return out


def in_metres(value: Column, crs_name: Column) -> Column:
    """The value, scaled from feet if the name of its reference system speaks of feet."""
    return F.when(F.lower(crs_name).rlike("foot|feet|ftus|us-ft"), value * F.lit(FEET_TO_METRES)).otherwise(value)


def stable_seed(ident: Column) -> Column:
    """28 bits of the text's md5: the same in every process and engine."""
    return F.conv(F.substring(F.md5(ident), 1, 7), 16, 10).cast("long")
