import pytest

from chronoloom.functions.labels import LABELS, METRIC
from chronoloom.plans.matchers import Matcher
from chronoloom.sources.options import CODECS, Options
from chronoloom.sources.store import Store
from chronoloom.streaming.ingest import read_rows, start_ingest

ROW = f"metric string, labels {LABELS}, ts long, value double, seq long"
T = 1_600_000_000


def rows(spark, *given):
    return spark.createDataFrame([(m, [("a", a)], ts, v, i) for i, (m, a, ts, v) in enumerate(given)], ROW)


@pytest.mark.parametrize("codec", CODECS)
def test_roundtrip(spark, tmp_path, codec):
    store = Store(spark, str(tmp_path / "s"), Options(codec=codec))
    store.append(rows(spark, ("m", "1", T, 1.0), ("m", "2", T + 7200, 2.0)), mode="errorifexists")
    store.append(rows(spark, ("n", "1", T, 3.0)))
    assert sorted(tuple(r) for r in store.query_range("m", [], T, T + 7200).collect()) == [('{__name__="m", a="1"}', T, 1.0), ('{__name__="m", a="2"}', T + 7200, 2.0)]
    assert store.query_range("m", [Matcher("a", "[2-9]", True)], T, T + 7200).count() == 1
    assert [r[0] for r in store.query_series([Matcher(METRIC, "m|n", True), Matcher("a", "1")], T, T).orderBy("labels_key").collect()] == ['{__name__="m", a="1"}', '{__name__="n", a="1"}']
    assert [r[0] for r in store.query_label_values(METRIC, T, T + 7200).collect()] == ["m", "n"]
    assert [r[0] for r in store.query_label_values("a", T, T + 7200).collect()] == ["1", "2"]
    with pytest.raises(FileExistsError):
        store.append(rows(spark, ("m", "1", T, 1.0)), mode="errorifexists")
    assert all(codec in p.name or codec == "uncompressed" for p in (tmp_path / "s").rglob("*.parquet"))


def test_codec_names():
    with pytest.raises(ValueError):
        Options(codec="lz77")


def test_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert store.query_range("m", [], 0, 10).count() == 0 and store.query_series([Matcher("a", "1")], 0, 10).count() == 0
    assert store.segments().count() == 0 and store.expire(T) == []


def test_expired_segments_are_removed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(retention_seconds=7200))
    store.append(rows(spark, ("m", "1", T, 1.0), ("m", "2", T + 72_000, 2.0)))
    assert store.expire(T + 72_000) == [T // 7200 * 7200]
    assert store.points().count() == 1 and store.series().count() == 1 and Store(spark, store.path).points().count() == 1


def test_outdated_points(spark, tmp_path):
    given = [("m", "1", T + 10, 1.0), ("m", "1", T + 5, 2.0)]
    keeps, drops = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"), Options(enable_outdated=False))
    for s in (keeps, drops):
        s.append(rows(spark, *given))
    assert keeps.points().count() == 2 and drops.points().count() == 1


def test_outdated_points_of_later_appends(spark, tmp_path):
    for store in (Store(spark, str(tmp_path / "s"), Options(enable_outdated=False)), Store(spark, options=Options(enable_outdated=False, only_memory=True))):
        for ts in (100, 50, 100, 101):
            store.append(rows(spark, ("m", "1", T + ts, 1.0), ("m", f"{ts}", T + ts, 1.0)))
        assert sorted(r["ts"] - T for r in store.query_range("m", [Matcher("a", "1")], T, T + 200).collect()) == [100, 101]
        assert store.query_range("m", [Matcher("a", "50")], T, T + 200).count() == 1


@pytest.mark.parametrize("seconds", [7_200, 86_400])
def test_ranges_within_segments(spark, tmp_path, seconds):
    store = Store(spark, str(tmp_path / "s"), Options(segment_seconds=seconds))
    given = [("m", str(i % 3), T + i * 600, float(i)) for i in range(300)]
    store.append(rows(spark, *given[:200]))
    store.append(rows(spark, *given[200:]))
    for start, end in ((T + 20_000, T + 28_000), (T, T + 599), (T + 86_000, T + 100_000), (T + 170_000, T + 400_000)):
        want = sorted((ts, v) for _, _, ts, v in given if start <= ts <= end)
        assert sorted((r["ts"], r["value"]) for r in store.query_range("m", [], start, end).collect()) == want
        assert sorted((r["ts"], r["value"]) for r in store.query_range("m", [], start, end, view="archive").collect()) == want
    assert not any(r["frozen"] for r in store.segments().collect())


def test_views_and_empty_series(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(segment_seconds=86_400))
    store.append(rows(spark, *(("m", "1", T + ts, float(i)) for i, ts in enumerate([10, 20, 20, 15, 30, 15])), ("m", "2", T + 5000, 9.0)))
    shown = {v: sorted((r["ts"] - T, r["value"]) for r in store.query_range("m", [], T, T + 100, view=v).collect()) for v in ("points", "hot", "archive")}
    assert len(shown["points"]) == 6
    assert shown["hot"] == [(10, 0.0), (15, 5.0), (20, 1.0), (20, 2.0), (30, 4.0)] and shown["archive"] == [(10, 0.0), (15, 5.0), (20, 1.0), (30, 4.0)]
    got = store.query_range("m", [], T + 25, T + 100, empty=True).collect()
    assert {(r["labels_key"], r["ts"] and r["ts"] - T) for r in got} == {('{__name__="m", a="1"}', 30), ('{__name__="m", a="2"}', None)}
    assert {r["labels_key"]: r["labels"] for r in store.query_series([Matcher("a", "2")], T, T + 100).collect()} == {'{__name__="m", a="2"}': {METRIC: "m", "a": "2"}}


def test_series_of_segments_touched_by_the_clock(spark, tmp_path):
    """Also of one whose first point comes after the range, or whose last comes before it."""
    store = Store(spark, str(tmp_path / "s"), Options(segment_seconds=86_400))
    day = T // 86_400 * 86_400
    store.append(rows(spark, ("m", "1", day + 10, 1.0), ("m", "2", day + 86_400 + 500, 2.0), ("m", "3", day + 2 * 86_400, 3.0)))
    span = (day + 1000, day + 86_400 + 100)
    got = store.query_range("m", [], *span, empty=True).collect()
    assert sorted(map(tuple, got)) == [(f'{{__name__="m", a="{i}"}}', None, None) for i in "12"]
    assert sorted(r["labels"]["a"] for r in store.query_series([Matcher("a", ".*", True)], *span).collect()) == ["1", "2"]
    assert store.query_series([Matcher("a", ".*", True)], *span, strict=True).collect() == []


def test_an_append_counts_once_and_when_committed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        store.append(rows(spark, ("m", "1", T, 1.0)), name="batch")
    assert store.points().count() == 1
    store.append(rows(spark, ("m", "2", T, 1.0)), name="broken")
    (tmp_path / "s" / "commits" / "broken").unlink()
    assert store.points().count() == 1 and [r[0] for r in store.query_label_values("a", T, T).collect()] == ["1"]
    store.append(rows(spark, ("m", "3", T, 1.0)), name="broken")
    assert [r[0] for r in store.query_label_values("a", T, T).collect()] == ["1", "3"]


def test_memory_only(spark):
    store = Store(spark, options=Options(only_memory=True))
    store.append(rows(spark, ("m", "1", T, 1.0)))
    store.append(rows(spark, ("m", "1", T + 1, 2.0)))
    assert store.query_range("m", [], T, T + 1).count() == 2 and store.series().count() == 1
    with pytest.raises(ValueError):
        store.expire(T)
    store.close()


def test_compaction_keeps_one_point_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, ("m", "1", T + 20, 1.0), ("m", "1", T + 20, 2.0), ("m", "1", T + 10, 3.0)))
    merged = store.compact(str(tmp_path / "t"))
    assert sorted((r["ts"], r["value"]) for r in merged.points().collect()) == [(T + 10, 3.0), (T + 20, 1.0)]
    assert merged.query_range("m", [], T, T + 30).count() == 2


def test_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    given = rows(spark, ("m", "1", T, 1.0), ("m", "2", T + 1, 2.0)).drop("seq")
    for _ in range(2):
        given.write.mode("append").parquet(str(tmp_path / "in"))
        stream = start_ingest(read_rows(spark, str(tmp_path / "in"), given.schema, 1), store, str(tmp_path / "c"))
        assert stream.awaitTermination(120)
    assert store.points().count() == 4 and store.points().select("seq").distinct().count() == 4
