"""Video frame tables: sampling, nearest in time, ranges, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled(frames: DataFrame, fps: float, interval: float, rounded: bool = True) -> DataFrame:
    """Every max(1, int(fps * interval))-th frame with its time, rounded half to even to the interval."""
    t = F.col("frame_number") / F.lit(float(fps))
    t = F.bround(t / interval) * F.lit(float(interval)) if rounded else t
    return frames.where(F.col("frame_number") % max(1, int(fps * interval)) == 0).withColumn("timestamp_s", t)


def nearest_in_time(frames: DataFrame, t: float, tolerance: float = 0.1) -> DataFrame:
    """The frame nearest to t, the first of equals, if within the tolerance."""
    gap = F.abs(F.col("timestamp_s") - F.lit(float(t)))
    best = frames.where(gap <= tolerance).agg(F.min(F.struct(gap.alias("gap"), "frame_number", "timestamp_s")).alias("b"))
    return best.where("b is not null").select("b.frame_number", "b.timestamp_s", "b.gap")


def in_range(frames: DataFrame, a: float, b: float) -> DataFrame:
    """Frames with a <= time <= b."""
    return frames.where(F.col("timestamp_s").between(a, b))


def per_second(frames: DataFrame, a: int, b: int, tolerance: float = 0.5) -> DataFrame:
    """For each whole second of a .. b the nearest frame within the tolerance.

    A frame is nearest to the two seconds around it at most, so frames are keyed by
    second and nothing is paired by range.
    """
    near = F.array_distinct(F.array(F.floor("timestamp_s"), F.ceil("timestamp_s"))).cast("array<int>")
    rows = frames.withColumn("second", F.explode(near)).where(F.col("second").between(a, b))
    rows = rows.withColumn("gap", F.abs(F.col("timestamp_s") - F.col("second"))).where(F.col("gap") <= tolerance)
    return rows.groupBy("second").agg(F.min(F.struct("gap", "frame_number")).alias("f")).select("second", "f.frame_number", "f.gap")


def statistics(frames: DataFrame) -> DataFrame:
    """Count, first and last time, span and mean step; no row without frames."""
    out = frames.agg(F.count("*").alias("n"), F.min("timestamp_s").alias("first"), F.max("timestamp_s").alias("last"))
    span = F.col("last") - F.col("first")
    return out.where("n > 0").withColumns({"span": span, "mean_step": F.try_divide(span, F.col("n") - 1)})


def frame_name(prefix: str, number: str = "frame_number", t: str = "timestamp_s") -> Column:
    """prefix_000123_4.10s.jpg"""
    return F.format_string(f"{prefix}_%06d_%.2fs.jpg", F.col(number), F.col(t))


def time_delta(cameras: DataFrame) -> DataFrame:
    """Seconds from the first to the last camera by position that has a datetime."""
    t = F.to_timestamp("datetime_raw", "yyyy:MM:dd HH:mm:ss")
    rows = cameras.withColumn("t", F.unix_timestamp(t)).where("t is not null")
    return rows.agg((F.max_by("t", "pos") - F.min_by("t", "pos")).alias("seconds"))


def timestamp_mapping(frames: DataFrame, interval: float, n: int) -> DataFrame:
    """The first n frames with exact and rounded time."""
    rounded = F.bround(F.col("timestamp_s") / interval) * F.lit(float(interval))
    return frames.orderBy("frame_number").limit(n).select("frame_number", "timestamp_s", rounded.alias("rounded_s"))


def gaps(frames: DataFrame) -> DataFrame:
    """Every frame's step from the one before."""
    return frames.withColumn("step", F.col("timestamp_s") - F.lag("timestamp_s").over(Window.orderBy("frame_number")))
