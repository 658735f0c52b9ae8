import sys
from pathlib import Path

import pytest
from helpers import DOCS, docs_of, saved
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from chronoloom.llm import bpe, mixing, near_dup, quality_rules, secrets  # noqa: E402


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dup", "secrets", "mixing", "bpe"]


def test_run_is_the_operators_in_order(spark, sf_dir):
    """Against what each operator says of the rows before it, which their own tests hold to brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r["doc_id"] for r in quality_rules.judge_documents(docs).collect() if r["kept"]}
    docs = docs.where(F.col("doc_id").isin(*judged))
    firsts = {r["class_id"] for r in near_dup.duplicate_classes(docs).collect()}
    docs = docs.where(F.col("doc_id").isin(*firsts))
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs).collect()}
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_sources(secrets.mask_secrets(docs)).collect()}
    library = Tokenizer.from_file(bpe.production_path())
    got, places = {}, {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append(r["ids"])
        places[r["doc_id"], r["copy"]] = r["position"]
    assert set(got) <= set(masked)
    for i, ids in got.items():
        assert all(x == library.encode(masked[i], add_special_tokens=False).ids for x in ids)
    assert all(abs(len(got.get(i, [])) - t / s) <= 0.5 for i, (t, s) in taken.items())
    assert set(places) == {(i, c) for i, ids in got.items() for c in range(len(ids))}
    planned = {(r["doc_id"], c): r[p] for r in mixing.mix_sources(secrets.mask_secrets(docs)).collect() for c, p in ((0, "position"), (1, "second_position"))}
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    largest = {}
    for i, (_, size) in taken.items():
        largest[sources[i]] = max(largest.get(sources[i], 0), size)
    due = {sources[r["doc_id"]]: r["target"] for r in mixing.mix_sources(secrets.mask_secrets(docs)).collect()}
    # Up to the words by which whole texts miss the target; a schedule's weight is no less than a half.
    assert all(abs(p - planned[x]) <= 2 * largest[sources[x[0]]] / due[sources[x[0]]] for x, p in places.items())
    for source in set(sources.values()):
        own = [x for x in places if sources[x[0]] == source]
        assert sorted(own, key=places.get) == sorted(own, key=planned.get)


@pytest.mark.parametrize("stage", range(5))
def test_edges(spark, tmp_path, stage):
    text = "ten words or more of plain prose so that the rules let it pass number {}"
    rows = [(i, text.format(i), [None, "a", "b"][i % 3]) for i in range(30)] + [(None, text.format("x"), "a"), (None, None, None), (3, "", "a"), (4, text.format(4), "b"), (4, text.format(4), "b"), (7, "w " * 9000, "a")]
    clash = docs_of(spark, rows).select("*", *(F.lit(1).alias(c) for c in ("size", "words", "spans", "print", "key", "label", "host", "start", "part", "n_words", "class_id", "position", "_at")))
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, clash, str(tmp_path))
    found = out.collect()
    if name == "bpe":
        assert len(found) == len(rows)
    else:
        assert out.columns == clash.columns and found
    assert f(spark, clash.limit(0), str(tmp_path)).collect() == []


def test_empty_documents(spark, tmp_path):
    d = saved(spark, tmp_path, documents=spark.createDataFrame([], DOCS))
    assert corpus_pipeline.run(spark, d).collect() == []


def test_encode_moves_each_text_once(spark, tmp_path, monkeypatch):
    """No exchange holds codes; rows repeated often are placed alike."""
    rows = [(i % 40, f"words of text {i % 40}", "ab"[i % 2]) for i in range(70)] + [(None, None, None)] * 3 + [(5, "other words", "a")]
    docs = docs_of(spark, rows)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.encode(spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        above = plan[: next(i for i, line in enumerate(plan) if "MapInArrow" in line)]
        assert not any("Exchange" in line for line in above)
        plan = [line for line in plan if "Aggregate" in line and "text" in line]
        assert len(plan) == 2  # before and after the one exchange
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    library = Tokenizer.from_file(bpe.production_path())
    assert len(got) == len(rows) and len({(r[0], tuple(r[1]), r[2]) for r in got}) == len(rows)
    texts = {r[:2] for r in rows}
    assert {(i, tuple(ids)) for i, ids, _, _ in got} == {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts}
    monkeypatch.setattr(corpus_pipeline, "OFTEN", 1)
    assert sorted(map(tuple, corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()), key=repr) == got
