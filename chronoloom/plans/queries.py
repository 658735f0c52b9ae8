"""The registered queries over the events table, and the SQL that says the same."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import METRIC, filter_labels, has_label, label_map, labels_hash as hash_of, labels_string
from ..functions.time import RETENTION_SECONDS, SEGMENT_SECONDS
from ..operators import codec, ingest, postings, search, segments
from ..sources.events import event_rows, event_stream
from ..sources.options import Options
from ..sources.store import Store
from ..streaming.ingest import start_ingest
from .matchers import Matcher, effective, predicate

#: The time range of all of January 2024 and one of two days, whose edges aren't segments' edges.
MONTH = (1_704_067_200, 1_706_659_200)
DAYS = (1_704_156_600, 1_704_326_400)
HOUR = (1_704_200_000, 1_704_203_600)
#: A range that is one segment's first and last time at sf0.01.
EDGES = (1_704_168_063, 1_704_175_055)
NOW = MONTH[1]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_KEY = """concat('{__name__="', event_type, '", user_id="', user_id, '"}')"""
_EV = f"""ev AS (SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS uid, {_KEY} AS labels_key,
  epoch_us(ts) // 1000000 AS ts, epoch_us(ts) // 1000000 // {SEGMENT_SECONDS} * {SEGMENT_SECONDS} AS seg, value, event_id AS seq FROM events)"""
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_SPARSE = f"""sp AS (SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS uid, CASE WHEN {_K} >= 50 THEN CAST({_K} AS VARCHAR) END AS k,
  concat('{{__name__="', event_type, '"', CASE WHEN {_K} >= 50 THEN concat(', k="', {_K}, '"') ELSE '' END, ', user_id="', user_id, '"}}') AS labels_key,
  epoch_us(ts) // 1000000 AS ts, epoch_us(ts) // 1000000 // {SEGMENT_SECONDS} * {SEGMENT_SECONDS} AS seg, value, event_id AS seq FROM events)"""
_MANIFEST = f"""manifest AS (SELECT seg, min(ts) AS min_ts, max(ts) AS max_ts, count(DISTINCT labels_key) AS series_count, count(*) AS points_count,
  max(ts) - min(ts) > {SEGMENT_SECONDS} AS frozen FROM ev GROUP BY seg)"""


def _strict(start: int, end: int) -> str:
    return f"(min_ts < {start} AND max_ts > {start}) OR (min_ts > {start} AND max_ts < {end}) OR (min_ts < {end} AND max_ts > {end})"


def _inclusive(start: int, end: int) -> str:
    return f"min_ts <= {end} AND max_ts >= {start}"


def _chosen(start: int, end: int) -> str:
    return f"{_MANIFEST}, chosen AS (SELECT seg FROM manifest WHERE {_inclusive(start, end)})"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def points_of(spark: SparkSession, sf_dir: str, sparse: bool = False, span: tuple[int, int] | None = None) -> DataFrame:
    """Points of all events, or of the whole segments that a range touches."""
    start, end = (None, None) if span is None else (span[0] // SEGMENT_SECONDS * SEGMENT_SECONDS, (span[1] // SEGMENT_SECONDS + 1) * SEGMENT_SECONDS)
    return ingest.normalise(event_rows(spark, sf_dir, start, end, sparse))


# Rows, labels, series


@query(f"WITH {_EV} SELECT seg, metric, labels_key, ts, value, seq FROM ev")
def ingest_normalize(spark, sf_dir):
    return points_of(spark, sf_dir).drop("labels")


@query(f"WITH {_SPARSE} SELECT seg, metric, labels_key, ts, value, seq FROM sp")
def ingest_normalize_sparse(spark, sf_dir):
    return points_of(spark, sf_dir, sparse=True).drop("labels")


@query(f"WITH {_EV} SELECT DISTINCT seg, metric, labels_key FROM ev")
def series_catalog(spark, sf_dir):
    return ingest.series_catalog(points_of(spark, sf_dir)).select("seg", "metric", "labels_key")


@query(f"WITH {_SPARSE} SELECT seq, CASE WHEN k IS NULL THEN 'user_id' ELSE 'user_id,k' END AS names FROM sp")
def labels_filter(spark, sf_dir):
    kept = filter_labels(F.col("labels"))
    return event_rows(spark, sf_dir, sparse=True).select("seq", F.array_join(F.transform(kept, lambda x: x["name"]), ",").alias("names"))


@query(f"""WITH {_SPARSE} SELECT seq, concat('{{', CASE WHEN k IS NOT NULL THEN concat('k="', k, '", ') ELSE '' END, 'user_id="', uid, '"}}') AS labels FROM sp""")
def labels_string_(spark, sf_dir):
    return event_rows(spark, sf_dir, sparse=True).select("seq", labels_string(label_map(F.col("labels"))).alias("labels"))


QUERIES["labels_string"], ORACLES["labels_string"] = QUERIES.pop("labels_string_"), ORACLES.pop("labels_string_")


@query(f"WITH {_SPARSE} SELECT metric, count(DISTINCT labels_key) AS n_series, count(DISTINCT labels_key) AS n_hashes FROM sp GROUP BY metric")
def labels_hash(spark, sf_dir):
    """As many hashes as series: equal sets hash alike, others don't."""
    points = points_of(spark, sf_dir, sparse=True)
    return points.groupBy("metric").agg(F.countDistinct("labels_key").alias("n_series"), F.countDistinct(hash_of(F.col("labels"))).alias("n_hashes"))


@query(f"WITH {_SPARSE} SELECT seq, k IS NOT NULL AS has_k, false AS has_other FROM sp")
def labels_has(spark, sf_dir):
    points = points_of(spark, sf_dir, sparse=True)
    return points.select("seq", has_label(F.col("labels"), "k").alias("has_k"), has_label(F.col("labels"), "other").alias("has_other"))


# Range queries


def _range(spark, sf_dir, metric, matchers, span, sparse=False):
    rows = event_rows(spark, sf_dir, *span, sparse=sparse)
    return search.query_range(ingest.normalise(rows), metric, matchers, *span)


def _range_sql(where: str, span: tuple[int, int], cte: str = _EV, table: str = "ev") -> str:
    return f"WITH {cte} SELECT labels_key, ts, value FROM {table} WHERE ({where}) AND ts BETWEEN {span[0]} AND {span[1]}"


@query(_range_sql("metric = 'click' AND uid = '3'", MONTH))
def range_eq(spark, sf_dir):
    return _range(spark, sf_dir, "click", [Matcher("user_id", "3")], MONTH)


@query(_range_sql("metric = 'view' AND regexp_full_match(uid, '1.*|.*7')", DAYS))
def range_regex(spark, sf_dir):
    return _range(spark, sf_dir, "view", [Matcher("user_id", "1.*|.*7", True)], DAYS)


@query(_range_sql("metric = 'click' AND uid IN ('1', '2', '3', '5', '8')", MONTH))
def range_alternatives(spark, sf_dir):
    return _range(spark, sf_dir, "click", [Matcher("user_id", "1|2|3|5|8", True)], MONTH)


@query(_range_sql("metric = 'purchase' AND regexp_full_match(uid, '[0-9]') AND k IS NOT NULL AND regexp_full_match(k, '[5-7].')", MONTH, _SPARSE, "sp"))
def range_multi(spark, sf_dir):
    return _range(spark, sf_dir, "purchase", [Matcher("user_id", "[0-9]", True), Matcher("k", "[5-7].", True)], MONTH, sparse=True)


@query(_range_sql("metric = 'click' AND regexp_full_match(metric, 'c.*')", DAYS))
def range_name_intersection(spark, sf_dir):
    return _range(spark, sf_dir, "click", [Matcher(METRIC, "c.*", True)], DAYS)


@query(f"WITH {_EV} SELECT labels_key, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 6) AS total FROM ev WHERE metric = 'click' AND ts BETWEEN {DAYS[0]} AND {DAYS[1]} GROUP BY labels_key")
def range_nested(spark, sf_dir):
    points = search.nested(_range(spark, sf_dir, "click", [], DAYS))
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["value"])
    return points.select("labels_key", F.size("points").cast("long").alias("n_points"), F.get("points", F.lit(0))["ts"].alias("first_ts"), F.element_at("points", -1)["ts"].alias("last_ts"), F.round(total, 6).alias("total"))


@query(f"""WITH {_EV}, {_chosen(*HOUR)} SELECT labels_key, count(*) FILTER (WHERE ts BETWEEN {HOUR[0]} AND {HOUR[1]}) AS n_points
  FROM ev SEMI JOIN chosen USING (seg) GROUP BY labels_key""")
def range_empty_series(spark, sf_dir):
    return search.series_with_counts(points_of(spark, sf_dir, span=HOUR), [Matcher(METRIC, ".*", True)], *HOUR)


@query(f"""WITH {_EV}, {_chosen(*HOUR)} SELECT labels_key, count(*) FILTER (WHERE ts BETWEEN {HOUR[0]} AND {HOUR[1]}) AS n_points
  FROM ev SEMI JOIN chosen USING (seg) WHERE metric = 'view' GROUP BY labels_key""")
def range_empty_metric(spark, sf_dir):
    return search.with_empty(points_of(spark, sf_dir, span=HOUR), "view", [], *HOUR)


@query(f"WITH {_EV} SELECT labels_key, ts, value FROM ev")
def series_points_all(spark, sf_dir):
    return points_of(spark, sf_dir).select("labels_key", "ts", "value")


# Matchers


@query(f"""WITH {_EV} SELECT '{{__name__="click", user_id="("}}' AS labels_key, ts, value FROM ev WHERE metric = 'click' AND uid = '3' AND ts BETWEEN {MONTH[0]} AND {MONTH[1]}""")
def matcher_invalid_regex(spark, sf_dir):
    """A pattern that is none is compared as text; user 3 is named by it."""
    named = F.transform("labels", lambda x: F.struct(x["name"].alias("name"), F.when(x["value"] == "3", "(").otherwise(x["value"]).alias("value")))
    points = ingest.normalise(event_rows(spark, sf_dir, *MONTH).withColumn("labels", named))
    return search.query_range(points, "click", [Matcher("user_id", "(", True)], *MONTH)


@query(_range_sql("metric = 'click' AND starts_with(uid, '2')", MONTH))
def matcher_prefix_pushdown(spark, sf_dir):
    return _range(spark, sf_dir, "click", [Matcher("user_id", "2.*", True)], MONTH)


@query(_range_sql("metric = 'click' AND uid = '3'", MONTH))
def matcher_filter(spark, sf_dir):
    given = [Matcher("user_id", "3"), Matcher("user_id", "4"), Matcher("", "x"), Matcher("k", "")]
    assert effective(given) == given[:1]
    return _range(spark, sf_dir, "click", given, MONTH)


@query(f"WITH {_EV} SELECT 'range' AS question, count(DISTINCT labels_key) AS n FROM ev WHERE metric = 'click' UNION ALL SELECT 'series', 0")
def matcher_empty_value(spark, sf_dir):
    points, empty = points_of(spark, sf_dir), [Matcher("user_id", "")]
    ranged = search.query_range(points, "click", empty, *MONTH).select("labels_key").distinct()
    series = search.query_series(points, empty, *MONTH)
    return ranged.agg(F.count("*").alias("n")).select(F.lit("range").alias("question"), "n").unionByName(series.agg(F.count("*").alias("n")).select(F.lit("series").alias("question"), "n"))


@query(f"WITH {_SPARSE} SELECT DISTINCT labels_key FROM sp WHERE k IS NOT NULL")
def matcher_absent_label(spark, sf_dir):
    return search.query_series(points_of(spark, sf_dir, sparse=True), [Matcher("k", ".*", True)], *MONTH)


# Series and label values


def _series_sql(where: str, span: tuple[int, int], select: str = "labels_key") -> str:
    return f"WITH {_EV}, {_chosen(*span)} SELECT DISTINCT {select} FROM ev SEMI JOIN chosen USING (seg) WHERE {where}"


def _series(spark, sf_dir, matchers, span):
    return search.query_series(points_of(spark, sf_dir, span=span), matchers, *span)


@query(_series_sql("metric = 'click' AND uid = '3'", MONTH))
def series_eq(spark, sf_dir):
    return _series(spark, sf_dir, [Matcher(METRIC, "click"), Matcher("user_id", "3")], MONTH)


@query(_series_sql("regexp_full_match(metric, 'c.*|v.*')", DAYS))
def series_regex(spark, sf_dir):
    return _series(spark, sf_dir, [Matcher(METRIC, "c.*|v.*", True)], DAYS)


@query(_series_sql("true", DAYS))
def series_multi_segment(spark, sf_dir):
    return _series(spark, sf_dir, [Matcher("user_id", ".+", True)], DAYS)


@query(_series_sql("regexp_full_match(metric, '.*i.*') AND regexp_full_match(uid, '[0-9]{1,2}')", DAYS))
def series_multi_matcher(spark, sf_dir):
    return _series(spark, sf_dir, [Matcher(METRIC, ".*i.*", True), Matcher("user_id", "[0-9]{1,2}", True)], DAYS)


@query(_series_sql("regexp_full_match(uid, '1.*') AND regexp_full_match(uid, '.*2')", MONTH))
def series_same_name(spark, sf_dir):
    return _series(spark, sf_dir, [Matcher("user_id", "1.*", True), Matcher("user_id", ".*2", True)], MONTH)


@query(_series_sql("false", MONTH))
def series_no_matcher(spark, sf_dir):
    return _series(spark, sf_dir, [], MONTH)


@query(_series_sql("true", DAYS, "uid AS value"))
def label_values(spark, sf_dir):
    return search.query_label_values(points_of(spark, sf_dir, span=DAYS), "user_id", *DAYS)


@query(_series_sql("true", DAYS, "metric AS value"))
def metric_names(spark, sf_dir):
    return search.query_label_values(points_of(spark, sf_dir, span=DAYS), METRIC, *DAYS)


@query(_series_sql("false", DAYS, "uid AS value"))
def label_values_unknown(spark, sf_dir):
    return search.query_label_values(points_of(spark, sf_dir, span=DAYS), "no_such_label", *DAYS)


# Segments


@query(f"WITH {_EV}, {_MANIFEST} SELECT seg, min_ts, max_ts, series_count, points_count FROM manifest")
def segment_manifest(spark, sf_dir):
    return segments.manifest(points_of(spark, sf_dir)).drop("frozen")


@query(f"WITH ev AS (SELECT *, ts // 86400 * 86400 AS seg FROM (SELECT {_KEY} AS labels_key, epoch_us(ts) // 1000000 AS ts FROM events)), {_MANIFEST} SELECT seg, frozen, max_ts - min_ts > 86400 AS frozen_day FROM manifest")
def segment_frozen(spark, sf_dir):
    # Points cut by days, of a segment length of two hours and of a day.
    points = ingest.normalise(event_rows(spark, sf_dir), 86_400)
    days = segments.manifest(points, 86_400).select("seg", F.col("frozen").alias("frozen_day"))
    return segments.manifest(points).select("seg", "frozen").join(days, "seg")


def _choice(strict: bool, span: tuple[int, int]):
    def run(spark, sf_dir):
        return segments.choose_segments(segments.manifest(points_of(spark, sf_dir)), *span, strict).select("seg", "min_ts", "max_ts")

    return run


query(f"WITH {_EV}, {_MANIFEST} SELECT seg, min_ts, max_ts FROM manifest WHERE {_strict(*DAYS)}", "choose_segments")(_choice(True, DAYS))
query(f"WITH {_EV}, {_MANIFEST} SELECT seg, min_ts, max_ts FROM manifest WHERE {_inclusive(*EDGES)}", "choose_segments_inclusive")(_choice(False, EDGES))


@query(f"WITH {_EV}, {_MANIFEST} SELECT seg, max_ts FROM manifest WHERE {NOW} - max_ts <= {RETENTION_SECONDS}")
def retention(spark, sf_dir):
    return segments.retained(segments.manifest(points_of(spark, sf_dir)), NOW).select("seg", "max_ts")


# Postings


@query(f"""WITH {_EV} SELECT DISTINCT seg, '__name__' AS name, metric AS value, labels_key FROM ev UNION ALL SELECT DISTINCT seg, 'user_id', uid, labels_key FROM ev""")
def label_postings(spark, sf_dir):
    return postings.build_postings(ingest.series_catalog(points_of(spark, sf_dir)))


@query(f"""WITH {_SPARSE}, s AS (SELECT DISTINCT labels_key, metric, uid, k FROM sp), p AS (
  SELECT labels_key, '__name__' AS name, metric AS value FROM s UNION ALL SELECT labels_key, 'user_id', uid FROM s UNION ALL SELECT labels_key, 'k', k FROM s WHERE k IS NOT NULL)
  SELECT name, value, count(DISTINCT labels_key) AS n_series FROM p GROUP BY name, value""")
def postings_cardinality(spark, sf_dir):
    return postings.cardinality(postings.build_postings(ingest.series_catalog(points_of(spark, sf_dir, sparse=True))))


@query(f"WITH {_EV} SELECT DISTINCT labels_key FROM ev WHERE regexp_full_match(metric, 'c.*|s.*') AND regexp_full_match(uid, '.*[05]')")
def postings_match(spark, sf_dir):
    index = postings.build_postings(ingest.series_catalog(points_of(spark, sf_dir)))
    return postings.match_postings(index, [Matcher(METRIC, "c.*|s.*", True), Matcher("user_id", ".*[05]", True)])


# Late points. Events come in order, so lateness is made: hours for times, days for segments, and an
# arrival order that mixes them.

_LATE = f"""d AS (SELECT {_KEY} AS labels_key, epoch_us(ts) // 1000000 // 3600 * 3600 AS ts, value, (event_id * 7919) % 1000003 AS seq FROM events),
 s AS (SELECT *, ts // 86400 * 86400 AS seg FROM d),
 late_split AS (SELECT *, ts <= coalesce(max(ts) OVER (PARTITION BY seg, labels_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM s)"""


def _late(spark, sf_dir, near=None):
    """Points with ``late``; near: a condition of series and segments, under which no other is ranked."""
    rows = event_rows(spark, sf_dir).withColumn("ts", (F.floor(F.col("ts") / 3600) * 3600).cast("long")).withColumn("seq", F.col("seq") * 7919 % 1000003)
    points = ingest.normalise(rows, 86_400)
    return ingest.late_split(points if near is None else points.where(near)).select("seg", "labels_key", "metric", "labels", "ts", "value", "seq", "late")


_LATE_COLUMNS = ["seg", "labels_key", "ts", "value", "seq", "late"]


@query(f"WITH {_LATE} SELECT {', '.join(_LATE_COLUMNS)} FROM late_split")
def late_split(spark, sf_dir):
    return _late(spark, sf_dir).select(*_LATE_COLUMNS)


_HOT = f"""WITH {_LATE}, hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg, labels_key, ts, late ORDER BY seq DESC) AS n FROM late_split) WHERE NOT late OR n = 1)"""
_ARCHIVE = f"""WITH {_LATE}, archive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg, labels_key, ts ORDER BY late, seq DESC) AS n FROM late_split) WHERE n = 1)"""


@query(f"{_HOT} SELECT {', '.join(_LATE_COLUMNS)} FROM hot")
def hot_view(spark, sf_dir):
    return ingest.hot_view(_late(spark, sf_dir)).select(*_LATE_COLUMNS)


@query(f"{_ARCHIVE} SELECT {', '.join(_LATE_COLUMNS)} FROM archive")
def archive_merge(spark, sf_dir):
    return ingest.archive_merge(_late(spark, sf_dir)).select(*_LATE_COLUMNS)


def _seen(spark, sf_dir, view) -> DataFrame:
    match = predicate([Matcher(METRIC, "click")], F.col("labels"), F.col("metric"))
    points = _late(spark, sf_dir, match & search.in_segments(*DAYS, 86_400))
    return view(points).where(search.in_range(*DAYS)).select("labels_key", "ts", "value")


_SEEN = f"""WHERE starts_with(labels_key, '{{__name__="click"') AND ts BETWEEN {DAYS[0]} AND {DAYS[1]}"""


@query(f"{_HOT} SELECT labels_key, ts, value FROM hot {_SEEN}")
def range_hot(spark, sf_dir):
    return _seen(spark, sf_dir, ingest.hot_view)


@query(f"{_ARCHIVE} SELECT labels_key, ts, value FROM archive {_SEEN}")
def range_archive(spark, sf_dir):
    return _seen(spark, sf_dir, ingest.archive_merge)


@query(f"""WITH {_EV}, a AS (SELECT *, ts - lag(ts) OVER (PARTITION BY seg, labels_key ORDER BY ts, seq) AS delta FROM (SELECT * REPLACE (ts // 86400 * 86400 AS seg) FROM ev)),
  b AS (SELECT abs(delta - lag(delta) OVER (PARTITION BY seg, labels_key ORDER BY ts, seq)) AS dod FROM a)
  SELECT CAST(CASE {' '.join(f'WHEN dod <= {most} THEN {bits}' for most, bits in codec.BUCKETS)} ELSE {codec.WIDEST} END AS INTEGER) AS bits, count(*) AS n_points FROM b WHERE dod IS NOT NULL GROUP BY 1""")
def dod_buckets(spark, sf_dir):
    return codec.dod_buckets(ingest.normalise(event_rows(spark, sf_dir), 86_400))


# Storage


def scratch(spark: SparkSession) -> str:
    """A folder that all executors see, for a store that is written to be read back."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="stores-"))
    number = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{spark.sparkContext.getCheckpointDir()}/store-{number}"


def _roundtrip(codec_name: str):
    def run(spark, sf_dir):
        # Days for segments: two-hour ones would be folders by the hundred.
        store = Store(spark, scratch(spark), Options(codec=codec_name, segment_seconds=86_400))
        store.append(event_rows(spark, sf_dir), mode="errorifexists")
        joined = store.points().join(store.series().select("seg", "labels_key", F.element_at("labels", "user_id").alias("user_id")), ["seg", "labels_key"])
        return joined.select("seg", "metric", "labels_key", "user_id", "ts", "value", "seq")

    return run


for _name, _codec in (("store_roundtrip", "zstd"), ("store_roundtrip_none", "uncompressed"), ("store_roundtrip_zstd", "zstd"), ("store_roundtrip_snappy", "snappy")):
    query(f"WITH {_EV} SELECT ts // 86400 * 86400 AS seg, metric, labels_key, uid AS user_id, ts, value, seq FROM ev", _name)(_roundtrip(_codec))


@query(f"WITH {_EV} SELECT labels_key, ts, value FROM ev WHERE metric = 'click' AND uid = '3' AND ts BETWEEN {MONTH[0]} AND {MONTH[1]}")
def store_range(spark, sf_dir):
    return _stored(spark, sf_dir).query_range("click", [Matcher("user_id", "3")], *MONTH)


def _stored(spark, sf_dir):
    store = Store(spark, scratch(spark), Options(codec="zstd", segment_seconds=86_400))
    store.append(event_rows(spark, sf_dir))
    return store


#: A range that begins and ends within segments of a day.
WITHIN = (1_704_200_000, 1_704_700_000)


@query(f"WITH {_EV} SELECT labels_key, ts, value FROM ev WHERE metric = 'click' AND ts BETWEEN {WITHIN[0]} AND {WITHIN[1]}")
def store_range_within(spark, sf_dir):
    return _stored(spark, sf_dir).query_range("click", [], *WITHIN)


@query(f"""WITH {_EV}, m AS (SELECT DISTINCT labels_key FROM ev WHERE metric = 'click' AND ts // 86400 BETWEEN {WITHIN[0] // 86400} AND {WITHIN[0] // 86400 + 1})
  SELECT m.labels_key, e.ts, e.value FROM m LEFT JOIN ev e ON m.labels_key = e.labels_key AND e.ts BETWEEN {WITHIN[0]} AND {WITHIN[0] + 43_200}""")
def store_range_empty(spark, sf_dir):
    return _stored(spark, sf_dir).query_range("click", [], WITHIN[0], WITHIN[0] + 43_200, empty=True)


@query(f"WITH {_EV} SELECT DISTINCT labels_key, uid AS user_id FROM ev WHERE metric IN ('click', 'view') AND uid LIKE '1%' AND ts // 86400 BETWEEN {WITHIN[0] // 86400} AND {WITHIN[1] // 86400}")
def store_series(spark, sf_dir):
    found = _stored(spark, sf_dir).query_series([Matcher(METRIC, "click|view", True), Matcher("user_id", "1.*", True)], *WITHIN)
    return found.select("labels_key", F.element_at("labels", "user_id").alias("user_id"))


@query(f"WITH {_EV} SELECT ts // 86400 * 86400 AS seg, metric, labels_key, ts, value, seq FROM ev")
def stream_ingest(spark, sf_dir):
    path = scratch(spark)
    store = Store(spark, path, Options(codec="zstd", segment_seconds=86_400))
    start_ingest(event_stream(spark, sf_dir), store, f"{path}-progress").awaitTermination()
    return store.points()


@query(f"WITH {_LATE} SELECT seg, labels_key, ts, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY seg, labels_key, ts ORDER BY late, seq DESC) AS n FROM late_split) WHERE n = 1")
def store_compact(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("ts", (F.floor(F.col("ts") / 3600) * 3600).cast("long")).withColumn("seq", F.col("seq") * 7919 % 1000003)
    path = scratch(spark)
    store = Store(spark, path, Options(codec="zstd", segment_seconds=86_400))
    store.append(rows)
    return store.compact(f"{path}-sealed").points().select("seg", "labels_key", "ts", "value", "seq")
