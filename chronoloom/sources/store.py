"""A store of points and series as Parquet tables, partitioned by segment.

``points`` holds seg, metric, labels_key, ts, value and seq, sorted by metric, series and time within
a file; ``series`` holds seg, metric, labels_key and labels. Each append writes both under a name of its
own and then commits them at once, by one empty file of that name; readers see committed appends only.
A name that is committed isn't written again, so that a batch may be run twice. Series are made distinct
when read; compact() makes one append of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import METRIC
from ..operators import search
from ..operators.ingest import archive_merge, drop_late, hot_view, late_split, normalise, series_catalog, series_of_rows
from ..operators.segments import choose_segments, manifest, retained
from ..plans.matchers import Matcher, predicate, range_matchers
from .options import Options

POINTS = "seg long, metric string, labels_key string, ts long, value double, seq long"
#: What becomes of late and repeated points, by the state of their segment.
VIEWS = {"hot": hot_view, "archive": archive_merge}
SERIES = "seg long, metric string, labels_key string, labels map<string,string>"


class Store:
    """append(rows), the three queries, segments() and expire(now) over a path, or over memory."""

    def __init__(self, spark: SparkSession, path: str = ".", options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._held: dict[str, DataFrame] = {}

    # Writing

    def append(self, rows: DataFrame, mode: str = "append", name: str | None = None) -> None:
        """Add rows; mode 'errorifexists' refuses to write to a store that has any. name: of the
        append, for one that may be run again."""
        seconds, committed = self.options.segment_seconds, self._committed()
        if mode == "errorifexists" and committed:
            raise FileExistsError(f"{self.path} has points")
        if name in committed:
            return
        points = normalise(rows, seconds)
        if not self.options.enable_outdated:
            points = self._in_order(points)
        if self.options.only_memory:
            self._held[name or uuid.uuid4().hex] = points.persist(StorageLevel.MEMORY_AND_DISK)
            return
        flat = points.select("seg", "metric", "labels_key", "ts", "value", "seq")
        series = series_of_rows(rows, seconds) if self.options.enable_outdated else series_catalog(points)
        self._write(flat, series, name or uuid.uuid4().hex)

    def _in_order(self, points: DataFrame) -> DataFrame:
        """points without those that are late, by the points of this append and of all before."""
        stored = self.points().groupBy("seg", "labels_key").agg(F.max("ts").alias("last"))
        fresh = drop_late(late_split(points)).drop("late")
        return fresh.join(stored, ["seg", "labels_key"], "left").where(F.col("last").isNull() | (F.col("ts") > F.col("last"))).select(*points.columns)

    def _write(self, points: DataFrame, series: DataFrame, name: str) -> None:
        for kind, table, order in (("points", points, ["seg", "metric", "labels_key", "ts"]), ("series", series, ["seg", "metric", "labels_key"])):
            # By hash, not in ranges: finding ranges would read all rows twice. A segment's series are dealt
            # to so many tasks, so files are few; a series of a segment has no more points than it has
            # seconds, repeats apart.
            dealt = table.repartition("seg", F.pmod(F.xxhash64("labels_key"), F.lit(self.options.files_per_segment))).sortWithinPartitions(*order)
            writer = dealt.write.mode("overwrite").option("compression", self.options.codec).option("maxRecordsPerFile", self.options.max_rows_per_file)
            writer.partitionBy("seg").parquet(f"{self.path}/{kind}/append={name}")
        fs, commit = self._file(f"commits/{name}")
        fs.create(commit, True).close()

    # Files

    def _file(self, below: str):
        """The file system and path of a file of the store."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _committed(self) -> list[str]:
        """Names of the appends, by name. Compaction makes them one."""
        if self.options.only_memory:
            return sorted(self._held)
        fs, root = self._file("commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []

    # Reading

    def _read(self, kind: str, schema: str) -> DataFrame:
        out, names = self.spark.createDataFrame([], schema), self._committed()
        columns = out.columns
        if self.options.only_memory:
            for name in names:
                out = out.unionByName(self._held[name].select(*columns))
            return out
        if not names:
            return out
        root = f"{self.path}/{kind}"
        reader = self.spark.read.schema(f"{schema}, append string").option("basePath", root)
        return reader.parquet(*(f"{root}/append={name}" for name in names)).select(*columns)

    def points(self) -> DataFrame:
        return self._read("points", POINTS)

    def series(self) -> DataFrame:
        """seg, metric, labels_key and labels, each series of a segment once."""
        return series_catalog(self._read("series", SERIES))

    def segments(self) -> DataFrame:
        return manifest(self.points(), self.options.segment_seconds)

    def query_range(self, metric: str, matchers: Sequence[Matcher], start: int, end: int, view: str = "points", empty: bool = False) -> DataFrame:
        """labels_key, ts and value of matching points.

        view: 'points' as they came, 'hot' as an open segment shows them, 'archive' as a sealed one
        does. empty: a row of null ts and value for each matching series of the segments that the range
        touches by the clock, if it has no point in the range.
        """
        seconds, series = self.options.segment_seconds, self._read("series", SERIES)
        # What makes a point late or repeated is of its own series and segment.
        points = self.points().where((F.col("metric") == metric) & search.in_segments(start, end, seconds))
        if view != "points":
            points = VIEWS[view](late_split(points))
        found = search.range_by_series(series, points, metric, matchers, start, end, seconds)
        if not empty:
            return found
        match = predicate(range_matchers(metric, matchers), F.col("labels"), F.col("metric"))
        matched = series.where(match & search.in_segments(start, end, seconds)).select("labels_key").distinct()
        return matched.join(found, "labels_key", "left").select("labels_key", "ts", "value")

    def query_series(self, matchers: Sequence[Matcher], start: int, end: int, strict: bool = False) -> DataFrame:
        """labels_key and labels (a map) of each matching series of the segments that the range touches by
        the clock; strict: by their points' own times, edges not counted."""
        match = predicate(matchers, F.col("labels"), F.col("metric"))
        near = self._read("series", SERIES).where(match & search.in_segments(start, end, self.options.segment_seconds))
        if strict:
            near = near.join(self._chosen(start, end, strict), "seg", "left_semi")
        return near.select("labels_key", "labels").dropDuplicates(["labels_key"])

    def query_label_values(self, name: str, start: int, end: int, strict: bool = False) -> DataFrame:
        value = F.col("metric") if name == METRIC else F.element_at("labels", name)
        near = self._read("series", SERIES).where(search.in_segments(start, end, self.options.segment_seconds)).select("seg", value.alias("value")).where(F.col("value").isNotNull())
        return near.join(self._chosen(start, end, strict), "seg", "left_semi").select("value").distinct().orderBy("value")

    def _chosen(self, start: int, end: int, strict: bool) -> DataFrame:
        """seg of the segments that the range touches by their points' own times."""
        near = self.points().where(search.in_segments(start, end, self.options.segment_seconds))
        spans = near.groupBy("seg").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
        return choose_segments(spans, start, end, strict).select("seg")

    # Upkeep

    def compact(self, target: str) -> Store:
        """A store at target with one point for each series and time, as sealed segments have it."""
        out = Store(self.spark, target, self.options)
        if out._committed():
            raise FileExistsError(f"{target} has points")
        merged = archive_merge(late_split(self.points())).select("seg", "metric", "labels_key", "ts", "value", "seq")
        out._write(merged, self.series(), uuid.uuid4().hex)
        return out

    def expire(self, now: int) -> list[int]:
        """Remove the segments past their retention; returns them. The list is of segments, so it is
        bounded by the store's age."""
        if self.options.only_memory:
            raise ValueError("a store in memory has no files to remove")
        segments = self.points().groupBy("seg").agg(F.max("ts").alias("max_ts"))
        stay = retained(segments, now, self.options.retention_seconds)
        gone = sorted(r["seg"] for r in segments.join(stay, "seg", "left_anti").select("seg").collect())
        for name in self._committed():
            for kind in ("points", "series"):
                for seg in gone:
                    fs, folder = self._file(f"{kind}/append={name}/seg={seg}")
                    fs.delete(folder, True)
        return gone

    def close(self) -> None:
        for held in self._held.values():
            held.unpersist()
        self._held.clear()
