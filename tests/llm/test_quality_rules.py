import re
from collections import Counter

from helpers import DOCS, EDGE_TEXTS, docs_of, rows_of, saved, sql_rows
from pyspark.sql import functions as F

from chronoloom.llm import quality_rules as q

REPEATS = ["a b c d e f a b c d e g", "x y " * 30, "one two three four five " * 2, "q w e r t q w e r t y", "l a b c d\nl a b c d\n \nm"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf_dir):
    texts = EDGE_TEXTS + REPEATS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = q.judge_documents(docs_of(spark, list(enumerate(texts)))).collect()
    for r in got:
        n = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in q.FEATURES) == n, texts[r["doc_id"]]
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_same_rows_as_sql(spark, tmp_path, sf_dir):
    assert rows_of(q.op4_quality_rules(spark, sf_dir)) == sql_rows(q.OP4_SQL, sf_dir)
    rows = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in EDGE_TEXTS + REPEATS for s in ("a", None, "b"))] + [(None, "x", "c")] * 2
    d = saved(spark, tmp_path, documents=docs_of(spark, rows))
    assert rows_of(q.op4_quality_rules(spark, d)) == sql_rows(q.OP4_SQL, d)


GOOD = "this text has words enough to pass and says nothing twice at all number {}"


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(i, GOOD.format(i) if i % 10 == 0 else "bad", "farm") for i in range(200)]
    rows += [(1000 + i, GOOD.format(i) if i % 10 else "bad", "fine") for i in range(200)]
    rows += [(2000, "bad", "small"), (2001, GOOD.format("x"), "small")]
    got = {r["doc_id"]: r for r in q.judge_documents(docs_of(spark, rows)).collect()}
    assert not got[0]["kept"] and not got[0]["base_failed"] and got[0]["host_rate"] > 0.8
    assert got[1001]["kept"] and got[1001]["host_rate"] < 0.15
    assert 0.1 < got[2001]["host_rate"] < 0.9
    kept = q.keep_documents(docs_of(spark, rows)).select("doc_id").collect()
    assert {r[0] for r in kept} == {i for i, r in got.items() if r["kept"]}


def test_the_query_rejects_a_planted_host(spark, tmp_path):
    """Under half of its documents fail, but far more than of other hosts; the limit is the prior's."""
    rows = [(h * 1000 + i, "bad" if i % (20 + h) == 0 else GOOD.format(i), f"host{h}") for h in range(12) for i in range(100)]
    rows += [(90_000 + i, "bad" if i % 20 < 9 else GOOD.format(i), "planted") for i in range(100)] + [(95_000, GOOD, None)]
    d = saved(spark, tmp_path, documents=docs_of(spark, rows))
    judged = q.op4_quality_rules(spark, d).collect()
    rejected = {r["doc_id"] for r in judged if not r["kept"] and not r["base_failed"]}
    assert rejected == {i for i, t, s in rows if s == "planted" and t != "bad"} and len(rejected) == 55
    assert 0.3 < next(r["host_rate"] for r in judged if r["doc_id"] == 90_000) < 0.5
    assert rows_of(q.op4_quality_rules(spark, d)) == sql_rows(q.OP4_SQL, d)


def test_clean_documents_stay(spark):
    rows = [(i, GOOD.format(i), f"h{i % 7}") for i in range(70)]
    assert all(r["kept"] for r in q.judge_documents(docs_of(spark, rows)).collect())


def test_kept_rows_are_whole(spark):
    docs = docs_of(spark, [(1, GOOD, None), (1, GOOD, None), (None, GOOD, "x"), (2, None, "x")]).withColumn("n_words", F.lit("own")).withColumn("bad_host", F.lit(1))
    got = q.keep_documents(docs)
    assert got.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "1", "None"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert q.judge_documents(empty).collect() == [] and q.keep_documents(empty).collect() == []


def test_long_text(spark):
    text = "a b c d e f g " * 20_000
    [r] = q.judge_documents(docs_of(spark, [(1, text)])).collect()
    assert r["n_words"] == 140_000 == r["n_repeat_words"]
