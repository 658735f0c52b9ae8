"""The three questions: points of series in a time range, label sets, and values of a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import MAX_TS, SEGMENT_SECONDS
from ..plans.matchers import Matcher, predicate, range_matchers
from .segments import choose_segments, manifest

#: Rows up to which matched series, once counted, may be broadcast to the points.
BROADCAST_SERIES = 100_000


def in_range(start: int, end: int) -> Column:
    """Points of the range, both ends included. A start below 0 counts as 0."""
    return F.col("ts").between(max(start, 0), min(end, MAX_TS))


def in_segments(start: int, end: int, segment_seconds: int = SEGMENT_SECONDS) -> Column:
    """The clock segments that the range touches: prunes partitions, which a test of ts doesn't."""
    return F.col("seg").between(max(start, 0) // segment_seconds * segment_seconds, min(end, MAX_TS) // segment_seconds * segment_seconds)


def query_range(points: DataFrame, metric: str, matchers: Sequence[Matcher], start: int, end: int, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """labels_key, ts and value of matching points, from points that hold their labels. No shuffle.
    segment_seconds, here and below: the length by which the points' segments were made."""
    match = predicate(range_matchers(metric, matchers), F.col("labels"), F.col("metric"))
    return points.where(match & in_segments(start, end, segment_seconds) & in_range(start, end)).select("labels_key", "ts", "value")


def chosen(points: DataFrame, start: int, end: int, strict: bool = False, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """seg of the segments that the range touches by their points' own first and last times.

    Only the segments that the clock lets touch the range are aggregated.
    """
    near = points.where(in_segments(start, end, segment_seconds))
    return choose_segments(manifest(near, segment_seconds), start, end, strict).select("seg")


def with_empty(points: DataFrame, metric: str, matchers: Sequence[Matcher], start: int, end: int, strict: bool = False, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """labels_key and n_points of every matching series of the chosen segments, none left out for
    want of points in the range."""
    match = predicate(range_matchers(metric, matchers), F.col("labels"), F.col("metric"))
    return _counted(points.where(match & in_segments(start, end, segment_seconds)), points, start, end, strict, segment_seconds)


def series_with_counts(points: DataFrame, matchers: Sequence[Matcher], start: int, end: int, strict: bool = False, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """As with_empty(), over the series of any metric that the matchers, taken as they are, match."""
    match = predicate(matchers, F.col("labels"), F.col("metric"))
    return _counted(points.where(match & in_segments(start, end, segment_seconds)), points, start, end, strict, segment_seconds)


def _counted(matched: DataFrame, points: DataFrame, start: int, end: int, strict: bool, segment_seconds: int) -> DataFrame:
    by_segment = matched.groupBy("seg", "labels_key").agg(F.count(F.when(in_range(start, end), 1)).alias("n"))
    found = by_segment.join(chosen(points, start, end, strict, segment_seconds), "seg", "left_semi")
    return found.groupBy("labels_key").agg(F.sum("n").alias("n_points"))


def nested(flat: DataFrame) -> DataFrame:
    """labels_key and points, an array of (ts, value) by ts. A series' whole range is one row, so this
    is for ranges that a row can hold."""
    return flat.groupBy("labels_key").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("points"))


def query_series(points: DataFrame, matchers: Sequence[Matcher], start: int, end: int, strict: bool = False, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """labels_key of the matching series in segments that the range touches, each once."""
    match = predicate(matchers, F.col("labels"), F.col("metric"))
    matched = points.where(match & in_segments(start, end, segment_seconds)).select("seg", "labels_key").distinct()
    return matched.join(chosen(points, start, end, strict, segment_seconds), "seg", "left_semi").select("labels_key").distinct()


def query_label_values(points: DataFrame, name: str, start: int, end: int, strict: bool = False, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """The label's values in segments that the range touches, each once, in byte order."""
    value = F.element_at("labels", name)
    present = points.where(in_segments(start, end, segment_seconds)).select("seg", value.alias("value")).where(F.col("value").isNotNull()).distinct()
    return present.join(chosen(points, start, end, strict, segment_seconds), "seg", "left_semi").select("value").distinct().orderBy("value")


def range_by_series(series: DataFrame, points: DataFrame, metric: str, matchers: Sequence[Matcher], start: int, end: int, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """As query_range(), for points kept apart from their series' labels.

    Matched series are counted: few enough are broadcast, more are joined by shuffle, where adaptive
    execution splits a series of very many points.
    """
    match = predicate(range_matchers(metric, matchers), F.col("labels"), F.col("metric"))
    keys = series.where(match & in_segments(start, end, segment_seconds)).select("seg", "labels_key").distinct()
    keys = F.broadcast(keys) if keys.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES else keys
    near = points.where((F.col("metric") == metric) & in_segments(start, end, segment_seconds) & in_range(start, end))
    return near.join(keys, ["seg", "labels_key"], "left_semi").select("labels_key", "ts", "value")
