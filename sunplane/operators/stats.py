"""Statistics of a run's rows, summaries of batches, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run_stats(rows: DataFrame) -> dict:
    """The manifest's figures in one pass of counts and one of exact percentiles."""
    counts = lambda c: {r[c]: r["count"] for r in rows.groupBy(c).count().collect()}
    one = rows.agg(
        F.count_if("on_building").alias("on_building"),
        F.count_if(~F.col("on_building")).alias("off_building"),
        F.percentile("mounting_confidence", F.array(F.lit(0.5), F.lit(0.1))).alias("confidence"),
        F.percentile("panel_rmse_m", F.array(F.lit(0.5), F.lit(0.9))).alias("rmse"),
    ).first()
    pair = lambda v: list(v) if v else [None, None]
    (c50, c10), (r50, r90) = pair(one["confidence"]), pair(one["rmse"])
    return {
        "mounting_type_counts": counts("mounting_type"),
        "mounting_rule_counts": counts("mounting_rule"),
        "on_building_count": one["on_building"],
        "off_building_count": one["off_building"],
        "mounting_confidence_p50": c50,
        "mounting_confidence_p10": c10,
        "panel_rmse_p50": r50,
        "panel_rmse_p90": r90,
        "flag_counts": {r["flag"]: r["count"] for r in rows.select(F.explode("flags").alias("flag")).groupBy("flag").count().collect()},
    }


def stats_table(rows: DataFrame) -> DataFrame:
    """The same figures as rows (measure, item, value), without a driver in between."""
    value = lambda m, item, v: F.struct(F.lit(m).alias("measure"), item.cast("string").alias("item"), v.cast("double").alias("value"))
    each = F.concat(
        F.array(
            value("mounting_type", F.col("mounting_type"), F.lit(1)),
            value("mounting_rule", F.col("mounting_rule"), F.lit(1)),
            value("on_building", F.col("on_building"), F.lit(1)),
        ),
        F.transform("flags", lambda f: value("flag", f, F.lit(1))),
    )
    counted = rows.select(F.explode(each).alias("e")).groupBy("e.measure", "e.item").agg(F.sum("e.value").alias("value"))
    told = rows.agg(
        F.percentile("mounting_confidence", F.lit(0.5)).alias("c50"),
        F.percentile("mounting_confidence", F.lit(0.1)).alias("c10"),
        F.percentile("panel_rmse_m", F.lit(0.5)).alias("r50"),
        F.percentile("panel_rmse_m", F.lit(0.9)).alias("r90"),
    ).select(
        F.explode(F.array(value("mounting_confidence", F.lit("p50"), F.col("c50")), value("mounting_confidence", F.lit("p10"), F.col("c10")), value("panel_rmse", F.lit("p50"), F.col("r50")), value("panel_rmse", F.lit("p90"), F.col("r90")))).alias("e")
    ).select("e.*")
    return counted.unionByName(told)


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its count, mean, 10th, 50th and 90th percentile."""
    packed = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    return rows.select(F.explode(packed).alias("m")).select("m.*").groupBy("measure").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), *[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (10, 50, 90)]
    )


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count) of equal bins from low to high; the last one includes high, values outside are left out."""
    v = F.col(column)
    at = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.filter((v >= low) & (v <= high)).groupBy(at.alias("bin")).count()


def azimuth_rose(rows: DataFrame, column: str, sectors: int = 24) -> DataFrame:
    """(sector, count) of equal sectors from north clockwise."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.floor(F.pmod(F.col(column), F.lit(360.0)) / (360.0 / sectors)).cast("int").alias("sector")).count()


def stratified_sample(rows: DataFrame, stratum: Column, ident: str, per_stratum: int) -> DataFrame:
    """The `per_stratum` rows of each stratum whose ids have the least md5; rows without a stratum are left out. The rank
    limit is applied in each partition before the shuffle, so a large stratum isn't gathered."""
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.col(ident)), F.col(ident)))
    return rows.withColumn("stratum", stratum).filter("stratum is not null").withColumn("nth", nth).filter(F.col("nth") <= per_stratum).drop("nth")


def total_bounds(shapes: DataFrame) -> DataFrame:
    return shapes.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def run_counts(polygons: DataFrame, groups: DataFrame, rows: DataFrame, failed_groups: DataFrame) -> DataFrame:
    """One row: polygons, tile_groups, attempted (polygons in groups), succeeded (rows), failed (attempted without a row)
    and failed_groups."""
    names = ("polygons", "tile_groups", "attempted", "succeeded", "failed_groups")
    row = lambda df, **v: df.select(*[v.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    one = F.lit(1)
    parts = row(polygons, polygons=one).unionByName(row(groups, tile_groups=one, attempted=F.size("polygon_ids"))).unionByName(row(rows, succeeded=one)).unionByName(row(failed_groups, failed_groups=one))
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).withColumn("failed", F.col("attempted") - F.col("succeeded"))
