import pytest
from helpers import DOCS, EDGE_TEXTS, docs_of, rows_of, saved, sql_rows
from pyspark.sql import functions as F

from chronoloom.llm import mixing
from chronoloom.llm.common import running_sum


def words(n):
    return "w " * n


def many(spark):
    rows = [(i, words(1 + i * 7 % 40), ["a", "b", "c", "d", None][0 if i % 3 else i % 5]) for i in range(400)]
    return docs_of(spark, rows)


def test_same_rows_as_sql(spark, tmp_path, sf_dir):
    assert rows_of(mixing.op1_mixing(spark, sf_dir)) == sql_rows(mixing.OP1_SQL, sf_dir)
    edges = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in EDGE_TEXTS for s in ("x", None, "é"))]
    d = saved(spark, tmp_path, documents=many(spark).unionByName(docs_of(spark, edges)).unionByName(docs_of(spark, [(None, "a b c", "x")] * 3)))
    assert rows_of(mixing.op1_mixing(spark, d)) == sql_rows(mixing.OP1_SQL, d)


def test_targets_and_takes(spark):
    got = mixing.mix_sources(many(spark)).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source_size"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6 * total
    for size, rs in by.items():
        assert size == sum(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.5
        assert rs[0]["target"] <= 2 * size


def test_positions_follow_the_schedules(spark):
    """By a time t, a source has given the words that its schedule's integral up to t calls for."""
    docs = docs_of(spark, [(i, words(20), "abc"[i % 3]) for i in range(900)])
    got = mixing.mix_plan(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), ["doc_id"], "size", "source").collect()
    for nth, schedule in enumerate(mixing.SCHEDULES):
        rows = [r for r in got if r["nth"] == nth]
        for t in (0.2, 0.5, 0.8):
            given = sum(w for r in rows for w, p in zip(r["times"], r["positions"], strict=True) if w and p < t)
            (_, a), (_, b) = schedule
            share = a * t + (b - a) * t * t / 2
            assert abs(given / rows[0]["target"] - share) < 0.03


@pytest.mark.parametrize("schedule", [((0, 1), (0.5, 3), (1, 0)), ((0, 0), (1, 2)), ((0, 2), (0.3, 2), (0.7, 0.5), (1, 0.5))])
def test_time_inverts_the_integral(spark, schedule):
    shares = [i / 50 for i in range(51)]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.time_of(F.col("s"), schedule).alias("t")).collect()
    for r in got:
        up_to, t = 0.0, r["t"]
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            x = min(max(t - t0, 0), t1 - t0)
            up_to += w0 * x + (w1 - w0) * x * x / (2 * (t1 - t0))
        assert abs(up_to / mixing.integral(schedule) - r["s"]) < 1e-9


def test_sorted_and_repeatable(spark):
    a, b = (mixing.mix_sources(many(spark).repartition(n)).collect() for n in (2, 7))
    assert a == b
    at = [r["position"] for r in a if r["position"] is not None]
    assert at == sorted(at)


def test_running_sum_of_one_hot_group(spark):
    df = spark.range(5000).select("id", F.lit("g").alias("g"), F.lit(1).cast("long").alias("one"))
    got = running_sum(df, ["g"], [F.col("id")], "one", "before").collect()
    assert all(r["before"] == r["id"] for r in got) and len(got) == 5000


def test_documents_are_whole_and_repeated(spark):
    docs = many(spark).withColumn("size", F.lit("own")).withColumn("at", F.lit(1))
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    before = {r["doc_id"]: r for r in docs.collect()}
    assert all(r == before[r["doc_id"]] for r in rows)
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix_sources(docs).collect()}
    times = {i: sum(r["doc_id"] == i for r in rows) for i in taken}
    assert all(abs(times[i] - taken[i]) <= 0.5 for i in taken)


def test_repeated_rows_share_their_place(spark):
    docs = docs_of(spark, [(1, words(5), "a")] * 6 + [(None, words(5), "a")] * 2 + [(2, words(5), "b")])
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 9 and sum(r["taken"] for r in got) == round(1.5 * 45)
    mixed = mixing.mix_documents(docs).collect()
    assert 11 <= len(mixed) <= 15


def test_nothing_to_mix(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).collect() == []
    blank = docs_of(spark, [(1, "", "a"), (2, None, None)])
    assert [(r["size"], r["target"], r["taken"], r["position"]) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0, None)] * 2
    assert mixing.mix_documents(blank).collect() == []
