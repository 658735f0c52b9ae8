"""Segments: their manifest, which of them a time range touches, which have had their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import RETENTION_SECONDS, SEGMENT_SECONDS


def manifest(points: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """seg, min_ts, max_ts, series_count, points_count and frozen: its times span more than a segment's
    length. One that the clock has cut by that length never does, one cut otherwise may.

    Series are counted after a grouping by them, so that no task holds a segment's series at once.
    """
    by_series = points.groupBy("seg", "labels_key").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    found = by_series.groupBy("seg").agg(F.min("a").alias("min_ts"), F.max("b").alias("max_ts"), F.count("*").alias("series_count"), F.sum("n").alias("points_count"))
    return found.withColumn("frozen", F.col("max_ts") - F.col("min_ts") > segment_seconds)


def overlaps(start: int, end: int, strict: bool = False, low: str = "min_ts", high: str = "max_ts") -> Column:
    """Whether a segment touches the range. strict: only if it crosses the start, lies within, or
    crosses the end, edges not counted."""
    a, b = F.col(low), F.col(high)
    if not strict:
        return (a <= end) & (b >= start)
    return ((a < start) & (b > start)) | ((a > start) & (b < end)) | ((a < end) & (b > end))


def choose_segments(segments: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    return segments.where(overlaps(start, end, strict))


def retained(segments: DataFrame, now: int, retention: int = RETENTION_SECONDS) -> DataFrame:
    """Segments that stay: their last point is no older than the retention. now is a parameter, so
    that a result doesn't depend on when it is asked for."""
    return segments.where(F.lit(now) - F.col("max_ts") <= retention)
