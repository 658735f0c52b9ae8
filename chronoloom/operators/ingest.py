"""Rows to points, and what becomes of late and repeated ones.

Rows are metric, labels (array of name and value), ts (seconds), value and seq, the order of arrival.
Points add seg, labels (map) and labels_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import rendered, sorted_labels, with_metric
from ..functions.time import MAX_TS, MIN_TS, SEGMENT_SECONDS, segment_of


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ts").between(MIN_TS, MAX_TS) & F.col("metric").isNotNull())


def quarantined(rows: DataFrame) -> DataFrame:
    """Rows that normalise() leaves out: of no metric, of no time, or of one outside the range."""
    return rows.where(~F.coalesce(F.col("ts").between(MIN_TS, MAX_TS), F.lit(False)) | F.col("metric").isNull())


def normalise(rows: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """Points of all rows whose time is in range. No shuffle."""
    entries = with_metric(F.col("labels"), F.col("metric"))
    points = valid(rows).select(segment_of(F.col("ts"), segment_seconds).alias("seg"), "metric", entries.alias("entries"), "ts", "value", "seq")
    return points.select("seg", "metric", rendered(F.col("entries")).alias("labels_key"), F.map_from_entries("entries").alias("labels"), "ts", "value", "seq")


def series_catalog(points: DataFrame) -> DataFrame:
    """seg, metric, labels_key and labels: one row for each series of a segment.

    Maps can't be grouped by, but their sorted entries can, by hash and in part before the shuffle.
    """
    keyed = points.select("seg", "metric", "labels_key", sorted_labels(F.col("labels")).alias("entries"))
    return keyed.distinct().select("seg", "metric", "labels_key", F.map_from_entries("entries").alias("labels"))


def series_of_rows(rows: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """As series_catalog(normalise(rows)), but rows of the same labels as written are made one first,
    so that few are normalised."""
    written = valid(rows).select("metric", "labels", segment_of(F.col("ts"), segment_seconds).alias("seg")).distinct()
    entries = written.select("seg", "metric", with_metric(F.col("labels"), F.col("metric")).alias("entries")).distinct()
    return entries.select("seg", "metric", rendered(F.col("entries")).alias("labels_key"), F.map_from_entries("entries").alias("labels"))


def late_split(points: DataFrame) -> DataFrame:
    """points with ``late``: not after all earlier arrivals of its series in the segment.

    Arrivals of one series and segment are bounded by the segment's length, unlike a series'.
    """
    arrival = Window.partitionBy("seg", "labels_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("late", F.col("ts") <= F.coalesce(F.max("ts").over(arrival), F.lit(0)))


def hot_view(split: DataFrame) -> DataFrame:
    """What an open segment shows: all points in order, and of late ones the last of each time."""
    same = Window.partitionBy("seg", "labels_key", "ts", "late").orderBy(F.col("seq").desc())
    return split.withColumn("nth", F.row_number().over(same)).where(~F.col("late") | (F.col("nth") == 1)).drop("nth")


def archive_merge(split: DataFrame) -> DataFrame:
    """What a sealed segment keeps: one point of each time, the one in order, else the last late one."""
    same = Window.partitionBy("seg", "labels_key", "ts").orderBy("late", F.col("seq").desc())
    return split.withColumn("nth", F.row_number().over(same)).where(F.col("nth") == 1).drop("nth")


def drop_late(split: DataFrame) -> DataFrame:
    """For stores that take no outdated points."""
    return split.where(~F.col("late"))
