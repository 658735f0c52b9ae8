import zlib

import numpy as np
from helpers import DOCS, EDGE_TEXTS, docs_of, saved

from chronoloom.llm import quality_gam as g


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in g.op5_quality_gam(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(r["quality"], got[r["doc_id"]]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got.values())
    assert sum(q == r["predicted"] for q, r in held) / len(held) > 0.95
    bad, fine = ([r["score"] for q, r in held if q == k] for k in (0, 1))
    assert np.mean(np.array(fine)[:, None] > np.array(bad)[None]) > 0.98


def test_held_out_labels_are_not_learned(spark, tmp_path, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(g.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = g.train(docs, labels), g.train(docs, flipped)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_fit_finds_main_effects_and_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = g.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.scores(x[3000:]) > 0.5) == y[3000:]) > 0.9
    one = (x[:, 2] > 0.3).astype(float)
    assert np.mean((g.fit(x[:3000], one[:3000]).scores(x[3000:]) > 0.5) == one[3000:]) > 0.97


def test_few_or_one_sided_labels():
    assert g.fit(np.zeros((0, 18)), np.zeros(0)).scores(np.zeros((1, 18)))[0] == 0.5
    assert 0.5 < g.fit(np.ones((3, 18)), np.ones(3)).scores(np.zeros((1, 18)))[0] < 1


def test_edges(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (4, 7, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    d = saved(spark, tmp_path, documents=docs_of(spark, [*enumerate(EDGE_TEXTS), (None, "x"), (1, "again")]), labels=labels)
    got = g.op5_quality_gam(spark, d).collect()
    assert len(got) == len(EDGE_TEXTS) + 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    d = saved(spark, tmp_path / "none", documents=spark.createDataFrame([], DOCS), labels=labels.limit(0))
    assert g.op5_quality_gam(spark, d).collect() == []


def test_reruns_agree(spark, sf_dir):
    a, b = (sorted(map(tuple, g.op5_quality_gam(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def plain_score(model, x):
    """Bins by counting edges below the value, values added one by one."""
    odds = model.intercept
    for f, v in enumerate(x):
        odds += model.tables[f][sum(e < v for e in model.edges[f])]
    for (a, b), grid in zip(model.pairs, model.grids, strict=True):
        odds += grid[sum(e < x[a] for e in model.coarse[a])][sum(e < x[b] for e in model.coarse[b])]
    return 1 / (1 + np.exp(-odds))


def test_scores_are_plain_bin_additions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = g.train(docs, labels)
    assert model.pairs and len(model.tables) == len(g.FEATURES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in g.op5_quality_gam(spark, sf_dir).collect():
        assert abs(r["score"] - plain_score(model, g.text_features(texts[r["doc_id"]] or ""))) < 1e-9


def quarters(n, m, i, j):
    return [(range(*r), range(*c)) for r in ((0, i), (i, n)) for c in ((0, j), (j, m))]


def test_steps_are_those_of_the_best_cuts():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        gradient, hessian = rnd.normal(size=12), rnd.random(12) * 4 * g.MIN_HESSIAN
        cuts = []
        for c in range(1, 12):
            parts = [(gradient[:c].sum(), hessian[:c].sum()), (gradient[c:].sum(), hessian[c:].sum())]
            if all(h >= g.MIN_HESSIAN for _, h in parts):
                cuts.append((sum(x * x / (h + g.RIDGE) for x, h in parts), c))
        step, (gain, c) = g._tree(gradient, hessian, 2), max(cuts)
        whole = gradient.sum() ** 2 / (hessian.sum() + g.RIDGE)
        for side in (slice(0, c), slice(c, 12)) if gain - whole > 1e-9 else (slice(0, 12),):
            assert np.allclose(step[side], gradient[side].sum() / (hessian[side].sum() + g.RIDGE))


def test_grid_steps_are_those_of_the_best_quarters():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        gradient, hessian = rnd.normal(size=(5, 4)), rnd.random((5, 4)) * g.MIN_HESSIAN
        best = (-1.0, None)
        for i in range(1, 5):
            for j in range(1, 4):
                sums = [(sum(gradient[a, b] for a in rs for b in cs), sum(hessian[a, b] for a in rs for b in cs)) for rs, cs in quarters(5, 4, i, j)]
                best = max(best, (sum(x * x / (h + g.RIDGE) for x, h in sums), (i, j)))
        gain, step = g._quadrants(gradient, hessian)
        assert abs(gain - best[0]) < 1e-9
        for rs, cs in quarters(5, 4, *best[1]):
            x, h = (sum(v[a, b] for a in rs for b in cs) for v in (gradient, hessian))
            assert all(abs(step[a, b] - x / (h + g.RIDGE)) < 1e-9 for a in rs for b in cs)


def test_repeated_keys_stay_within_the_pairs(spark):
    docs = docs_of(spark, [(1, f"text {i} of one key") for i in range(30)] + [(2, "another text, fine and plain")])
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = g.train(docs, labels, pairs=5)
    assert sum(len(e) for e in model.edges) <= 5 * len(g.FEATURES) and 0 < model.scores(np.zeros((1, len(g.FEATURES))))[0] < 1
