"""Readers: points from LAS files, polygons, footprints and tile indexes from Parquet, GeoJSON, GeoPackage and shapefiles."""
