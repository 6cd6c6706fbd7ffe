"""Intermediate tables in the shared folder, which cut the lineage of what is used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, spark.checkpoint.dir. If that is unset: a folder of this session's own
    where driver and executors are one process, else an error, as executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sunplane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written under the shared folder and read again, so that lost executors don't repeat what is above it."""
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that no plan to come reads."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """df with each row's place in the order, from 0. Rows are sorted by range and numbered in their partitions; only the
    partitions' counts meet in one task. The sorted rows are staged, so that both passes see the same partitions."""
    rows = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_part").withColumn(column, place).drop("_at", "_part", "_before")
