"""Runs from files to files: rows by partition, resumable, and a manifest."""

from __future__ import annotations

import dataclasses
import json
import logging
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunplane.config import Config
from sunplane.operators import assign, stats
from sunplane.operators.mounting import Classifier
from sunplane.plans import engine
from sunplane.plans.ship import ship
from sunplane.schema import OUTPUT, VERSION
from sunplane.sources import las, vector

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Inputs:
    """points: a folder or comma-joined list of LAS files, or a Parquet table of tile_id, x, y, z, cls."""

    polygons: str
    footprints: str
    tiles: str
    points: str
    tile_base: str = ""
    tile_template: str = "{name}.las"
    tile_name: str = "Name"


#: Tiles that a filter on the points names one by one; beyond, only the join with the groups leaves tiles out.
MOST_NAMED_TILES = 10_000


def read_points(spark: SparkSession, path: str, config: Config = Config(), tiles: list[str] | None = None) -> DataFrame:
    """Points of the tiles, or of all. Parquet points are better laid out by tile, so that other tiles' files aren't read."""
    if path.lower().rstrip("/").endswith((".parquet", ".pq")):
        points = spark.read.parquet(path).select("tile_id", "x", "y", "z", "cls")
        return points if tiles is None else points.filter(F.col("tile_id").isin(tiles))
    return las.read_las(spark, path, ignore_missing=True, crs=config.crs.target, lidar_reader=config.io.lidar_reader, tiles=tiles)


def ingest(spark: SparkSession, las_path: str, table: str) -> None:
    """LAS files to a Parquet table by tile, sorted by class and place so that row groups can be skipped."""
    points = las.read_las(spark, las_path)
    points.repartition("tile_id").sortWithinPartitions("cls", "x", "y").write.mode("overwrite").partitionBy("tile_id").parquet(table)


def existing(spark: SparkSession, output: str) -> DataFrame:
    """The rows of an earlier run; none if there are none."""
    try:
        return spark.read.schema(OUTPUT).parquet(f"{output}/rows")
    except AnalysisException:
        return spark.createDataFrame([], OUTPUT)


def manifest(config: Config, inputs: Inputs, run_id: str, counts: dict, figures: dict, tiles: list[str], spark: SparkSession) -> dict:
    return {
        "pkg_version": VERSION,
        "config_hash": config.hash,
        "config": dataclasses.asdict(config),
        "run_id": run_id,
        "inputs": inputs.__dict__,
        "cluster": {"master": spark.sparkContext.master, "spark_version": spark.version},
        "timestamp_utc": datetime.now(UTC).isoformat(),
        "counts": counts,
        "aggregate_stats": figures,
        "lidar_tiles": tiles,
    }


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop's file system, wherever the output lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def run_pipeline(spark: SparkSession, config: Config, inputs: Inputs, output: str, *, bbox=None, max_polygons: int | None = None, resume: bool = True, dry_run: bool = False, run_id: str | None = None, classifier: Classifier | None = None) -> dict:
    """Writes `output`/rows (Parquet by partition_id, by the executors) and `output`/manifest.json; returns the manifest.

    A resumed run skips groups whose partition has rows; with other inputs, use another output. A dry run only
    assigns polygons to tiles. Without resume, partitions that the run makes are replaced.
    """
    ship(spark)
    run_id = run_id or uuid.uuid4().hex
    polygons = vector.read_polygons(spark, inputs.polygons, config.crs.target, bbox=bbox, max_polygons=max_polygons)
    footprints = vector.read_footprints(spark, inputs.footprints, config.crs.target)
    tiles = vector.read_tile_index(spark, inputs.tiles, inputs.tile_base, inputs.tile_template, config.crs.target, inputs.tile_name)
    located, shaped = engine.with_measures(tiles), engine.with_measures(polygons)
    groups = assign.tile_groups(assign.assign(shaped, located, config.compute.tile_cell_size_m)).persist()
    touched = [r["tile_id"] for r in assign.tiles_touched(groups).orderBy("tile_id").collect()]
    if dry_run:
        counts = {"polygons": polygons.count(), "tile_groups": groups.count(), "attempted": 0, "succeeded": 0, "failed": 0}
        out = manifest(config, inputs, run_id, counts, {"dry_run": True}, touched, spark)
    else:
        todo = assign.pending(groups, existing(spark, output)) if resume else groups
        points = read_points(spark, inputs.points, config, touched if len(touched) <= MOST_NAMED_TILES else None)
        survey = engine.survey(points, groups, config)
        rows = engine.build_rows(points, polygons, footprints, tiles, config, run_id, only=todo.select("partition_id"), classifier=classifier, surveyed=survey)
        rows.write.option("maxRecordsPerFile", config.output.partition_size).mode("append" if resume else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_id").parquet(f"{output}/rows")
        done = existing(spark, output)
        if config.output.also_write_csv:
            text = done.withColumns({"flags": F.array_join("flags", ";"), "lidar_tile_ids": F.array_join("lidar_tile_ids", ";"), "geometry": F.hex("geometry")})
            text.write.mode("overwrite").option("header", True).csv(f"{output}/csv")
        counted = stats.run_counts(polygons, groups, done, groups.join(survey.select("tile_id"), F.col("primary_tile_id") == F.col("tile_id"), "left_anti")).first()
        out = manifest(config, inputs, run_id, counted.asDict(), stats.run_stats(done), touched, spark)
    groups.unpersist()
    write_text(spark, f"{output}/manifest.json", json.dumps(out, indent=1, sort_keys=True, default=str))
    return out
