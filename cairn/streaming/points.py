"""Streams of new points and frames. These go beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "point_id long, ts timestamp, x double, y double, z double"


def read_points(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def cell_counts(points: DataFrame, size: float) -> DataFrame:
    """Points and height range of every cell so far; state grows with cells, not points."""
    cell = lambda a: F.floor(F.col(a) / size).cast("long")
    return points.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


def windowed(points: DataFrame, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Points a time window, each point once within the watermark."""
    once = points.withWatermark("ts", late).dropDuplicatesWithinWatermark(["point_id"])
    return once.groupBy(F.window("ts", length)).agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))
