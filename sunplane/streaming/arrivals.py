"""Measures the polygons of each batch of arriving point files. An extra: the batch run is the engine's own interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sunplane.config import Config
from sunplane.plans import engine

POINTS = "tile_id string, x double, y double, z double, cls int"


def measure_arrivals(spark: SparkSession, incoming: str, polygons: DataFrame, footprints: DataFrame, tiles: DataFrame, output: str, checkpoint: str, config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Watches `incoming` for Parquet files of points. Each batch's tiles are measured by themselves and their rows
    appended under `output`/batch=<n>, which is overwritten when a batch is repeated, so that every file counts once.
    A tile's points must arrive in one batch."""

    def measure(points: DataFrame, n: int) -> None:
        engine.build_rows(points, polygons, footprints, tiles, config, f"batch-{n}").write.mode("overwrite").parquet(f"{output}/batch={n}")

    stream = spark.readStream.schema(POINTS).parquet(incoming).writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
