"""A scene derived from the sample tables in whole-number arithmetic: tiles from nation, footprints from supplier, polygons
from part, points from lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunplane.functions import shapes
from sunplane.operators.points import small

CELL = 1000.0
#: Places on a square lattice 25 m apart, and points made from each row of lineitem.
PLACES, POINTS_PER_ROW = 198, 12


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a file of few bytes is read by one task, however much is made of each of its rows."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _boxed(df: DataFrame) -> DataFrame:
    rings = shapes.box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return df.withColumn("rings", rings).withColumn("edges", shapes.edges(F.col("rings")))


def _place(n) -> tuple[Column, Column]:
    """The lattice point of number n, spread over the whole lattice."""
    q = (n * 7919) % (PLACES * PLACES)
    return 25 + 25 * (q % PLACES), 25 + 25 * F.floor(q / PLACES)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 by 5 grid of 1 km squares: tile_id, k, x0..y1, rings, edges."""
    k = F.col("n_nationkey")
    x0, y0 = (1000 * (k % 5)).cast("double"), (1000 * F.floor(k / 5)).cast("double")
    return _boxed(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("tile_id"), k.alias("k"), x0.alias("x0"), y0.alias("y0"), (x0 + 1000).alias("x1"), (y0 + 1000).alias("y1")))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each supplier around the place of every other polygon: building_id, s, x0..y1, rings, edges."""
    s = F.col("s_suppkey")
    px, py = _place(2 * s)
    cx, hx, hy = px + s % 5 - 2, 7 + s % 5, 7 + s % 7
    box = {"x0": cx - hx, "y0": py - hy, "x1": cx + hx, "y1": py + hy}
    return _boxed(_dealt(_table(spark, sf_dir, "supplier").select("s_suppkey")).select(F.concat(F.lit("b"), s.cast("string")).alias("building_id"), s.alias("s"), *[v.cast("double").alias(k) for k, v in box.items()]))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each part: polygon_id, p, cx, cy, w, h, the slopes sx and sy, x0..y1, area, rings, edges."""
    p = F.col("p_partkey")
    w, h = 3 + F.col("p_size") % 9, 3 + F.col("p_size") % 4
    px, py = _place(p)
    shift = F.when(p % 3 == 0, 9).otherwise(0)
    slope = lambda k: F.when(p % 10 == 0, F.lit(0.0)).otherwise((((k * p) % 21) - 10) / F.lit(20.0))
    rows = _dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        F.concat(F.lit("pv"), p.cast("string")).alias("polygon_id"), p.alias("p"), *[v.cast("double").alias(k) for k, v in {"cx": px + shift, "cy": py, "w": w, "h": h}.items()], slope(8).alias("sx"), slope(11).alias("sy")
    )
    half = lambda c, d, s: F.col(c) + F.lit(s) * F.col(d) / 2.0
    return _boxed(rows.withColumns({"x0": half("cx", "w", -1.0), "y0": half("cy", "h", -1.0), "x1": half("cx", "w", 1.0), "y1": half("cy", "h", 1.0), "area": F.col("w") * F.col("h")}))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, p, cls, x, y, z: POINTS_PER_ROW for each row of lineitem, around the rectangle of its part with 5 m to
    spare, on its plane 1 or 3 m over the ground, or on the ground, by return flag. Rows of lineitem meet their parts before
    they become points, so only they are shuffled for it."""
    lcg = lambda c: (F.lit(1103515245) * c + 12345) % F.lit(1 << 31)
    near = small(polygons(spark, sf_dir).select("p", "cx", "cy", "w", "h", "sx", "sy"))
    start = 7919 * F.col("l_orderkey") + 104729 * F.col("l_suppkey") + 1299709 * F.col("l_linenumber") + 15485863 * F.col("l_partkey")
    cls = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 6).otherwise(1)
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), cls.alias("cls"), start.alias("start")).join(near, "p")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(POINTS_PER_ROW - 1).cast("bigint"))).alias("m"))
    rows = rows.withColumn("a", lcg((F.col("start") + 32452843 * F.col("m")) % F.lit(1 << 31))).withColumn("b", lcg(F.col("a"))).withColumn("c", lcg(F.col("b")))
    unit = lambda k: F.col(k) / F.lit(2147483648.0) - F.lit(0.5)
    rows = rows.withColumns({"dx": unit("a") * (F.col("w") + 10.0), "dy": unit("b") * (F.col("h") + 10.0)})
    raised = F.col("sx") * F.col("dx") + F.col("sy") * F.col("dy") + F.lit(0.04) * unit("c") + F.when(F.col("p") % 2 == 0, F.lit(1.0)).otherwise(F.lit(3.0))
    rows = rows.select("p", "cls", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"), F.when(F.col("cls") == 2, F.lit(0.0)).otherwise(raised).alias("z"))
    names = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("tile_id"))
    at = (F.floor(F.col("x") / 1000) + 5 * F.floor(F.col("y") / 1000)).cast("int")
    return rows.withColumn("k", at).join(F.broadcast(names), "k").select("tile_id", "p", "cls", "x", "y", "z")


#: The same scene as DuckDB common table expressions.
SQL = f"""
tiles AS (
  SELECT n_name AS tile_id, n_nationkey AS k, (1000 * (n_nationkey % 5))::DOUBLE AS x0, (1000 * (n_nationkey // 5))::DOUBLE AS y0,
    (1000 * (n_nationkey % 5) + 1000)::DOUBLE AS x1, (1000 * (n_nationkey // 5) + 1000)::DOUBLE AS y1 FROM nation),
fp0 AS (
  SELECT s_suppkey AS s, (2 * s_suppkey * 7919) % {PLACES * PLACES} AS q, 25 + 25 * (q % {PLACES}) + s_suppkey % 5 - 2 AS cx, 25 + 25 * (q // {PLACES}) AS cy FROM supplier),
footprints AS (
  SELECT 'b' || s AS building_id, s, (cx - 7 - s % 5)::DOUBLE AS x0, (cy - 7 - s % 7)::DOUBLE AS y0, (cx + 7 + s % 5)::DOUBLE AS x1, (cy + 7 + s % 7)::DOUBLE AS y1 FROM fp0),
poly0 AS (
  SELECT 'pv' || p_partkey AS polygon_id, p_partkey AS p, (p_partkey * 7919) % {PLACES * PLACES} AS q,
    (25 + 25 * (q % {PLACES}) + CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE 0 END)::DOUBLE AS cx, (25 + 25 * (q // {PLACES}))::DOUBLE AS cy,
    (3 + p_size % 9)::DOUBLE AS w, (3 + p_size % 4)::DOUBLE AS h,
    CASE WHEN p_partkey % 10 = 0 THEN 0.0::DOUBLE ELSE ((8 * p_partkey) % 21 - 10)::DOUBLE / 20 END AS sx,
    CASE WHEN p_partkey % 10 = 0 THEN 0.0::DOUBLE ELSE ((11 * p_partkey) % 21 - 10)::DOUBLE / 20 END AS sy
  FROM part),
polygons AS (
  SELECT *, cx - w / 2 AS x0, cy - h / 2 AS y0, cx + w / 2 AS x1, cy + h / 2 AS y1, w * h AS area FROM poly0),
pt0 AS (
  SELECT l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 6 ELSE 1 END AS cls,
    (1103515245 * ((7919 * l_orderkey + 104729 * l_suppkey + 1299709 * l_linenumber + 15485863 * l_partkey + 32452843 * m) % 2147483648) + 12345) % 2147483648 AS a
  FROM lineitem, range({POINTS_PER_ROW}) r(m)),
pt1 AS (SELECT *, (1103515245 * a + 12345) % 2147483648 AS b FROM pt0),
pt2 AS (SELECT *, (1103515245 * b + 12345) % 2147483648 AS c FROM pt1),
pt3 AS (
  SELECT p, cls, cx, cy, sx, sy, (a::DOUBLE / 2147483648 - 0.5::DOUBLE) * (w + 10) AS dx, (b::DOUBLE / 2147483648 - 0.5::DOUBLE) * (h + 10) AS dy,
    c::DOUBLE / 2147483648 - 0.5::DOUBLE AS u FROM pt2 JOIN polygons USING (p)),
pt4 AS (
  SELECT p, cls, cx + dx AS x, cy + dy AS y, CASE WHEN cls = 2 THEN 0.0::DOUBLE ELSE
    sx * dx + sy * dy + 0.04::DOUBLE * u + CASE WHEN p % 2 = 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END END AS z FROM pt3),
points AS (
  SELECT tile_id, p, cls, x, y, z FROM pt4 JOIN tiles ON k = (floor(x / 1000) + 5 * floor(y / 1000))::INT)
"""


def sql(body: str) -> str:
    """The scene's expressions followed by more, or by a query that starts with SELECT."""
    return f"WITH {SQL.strip()}\n{'' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"
