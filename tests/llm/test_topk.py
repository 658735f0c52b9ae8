import math
import random

import numpy as np
import pytest
from helpers import rows_of, saved, sql_rows

from chronoloom.llm import topk

VECTORS = "vec_id long, embedding array<float>, label int"


def best(vectors, query_id, q, k):
    scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in vectors if i != query_id)
    return [(i, -s) for s, i in scored[:k]]


@pytest.mark.parametrize("shape", [(1, 3), (4, 1), (300, 8), (2000, 16)])
@pytest.mark.parametrize("kind", ["normal", "few", "copies", "zero"])
def test_block_search_is_exact(shape, kind):
    rnd = np.random.default_rng(shape[0])
    v = {"normal": rnd.normal(0, 40, shape), "few": rnd.integers(-2, 3, shape), "copies": np.repeat(rnd.normal(0, 40, (1, shape[1])), shape[0], 0) + (rnd.random(shape) < 0.02), "zero": np.zeros(shape)}[kind].astype(np.int64)
    ids = rnd.permutation(shape[0]).astype(np.int64)
    index = topk.build_block(ids, v)
    rows = list(zip(ids.tolist(), v.tolist(), strict=True))
    for query_id, q in rows[:20] + [(-1, rnd.integers(-50, 50, shape[1]).tolist()), (-2, [0] * shape[1])]:
        assert topk.search_block(index, query_id, np.array(q, np.int64), 5) == best(rows, query_id, q, 5)


def test_same_rows_as_sql(spark, tmp_path, sf_dir):
    assert rows_of(topk.op10_top_k(spark, sf_dir)) == sql_rows(topk.OP10_SQL, sf_dir)
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(4)], 0) for i in range(300)]
    rows += [(1000, None, 0), (1050, [1.0, None, 0.0, 0.0], 0), (1100, [math.nan] * 4, 0), (1150, [math.inf] * 4, 0), (-50, [0.1, -0.1, 0.0, 1.0], 0), (None, [1.0] * 4, 0), (7, [1.0] * 4, 0)]
    d = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, VECTORS))
    assert rows_of(topk.op10_top_k(spark, d)) == sql_rows(topk.OP10_SQL, d)


def test_blocks_and_query_blocks_don_t_matter(spark):
    rnd = random.Random(4)
    v = spark.createDataFrame([(i, [rnd.randint(-9, 9) for _ in range(3)]) for i in range(200)], "id long, v array<long>")
    q = v.where("id % 7 = 0")
    assert rows_of(topk.top_k(v, q, 4, block=13, query_block=3)) == rows_of(topk.top_k(v, q, 4))


def test_few_candidates_and_empty_tables(spark):
    v = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "id long, v array<long>")
    assert rows_of(topk.top_k(v, v, 5)) == [(0, 1, 11, 1), (1, 1, 11, 0)]
    assert topk.top_k(v.limit(0), v, 5).collect() == [] and topk.top_k(v, v.limit(0), 5).collect() == []
    assert topk.top_k(v.limit(1), v.limit(1), 5).collect() == []


def test_vectors_of_other_lengths_and_repeats(spark):
    v = spark.createDataFrame([(0, [1, 1]), (1, [5]), (2, []), (3, [1, 2, 9]), (3, [1, 2, 9]), (0, [1, 1])], "id long, v array<long>")
    got = rows_of(topk.top_k(v, v.where("id = 0"), 9))
    assert got == [(0, 1, 5, 1), (0, 2, 3, 3), (0, 3, 3, 3), (0, 4, 0, 2)]


def test_large_components_take_part(spark, tmp_path):
    """Integers beyond 2^26, up to those whose scores still are longs."""
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randint(-9, 9)) for _ in range(4)], 0) for i in range(200)]
    rows += [(200 + i, [rnd.choice([-1.0, 1.0]) * rnd.randint(2**18, 2**20), 0.5, float(2**19 + i), 1.0], 0) for i in range(60)]
    rows += [(300, [float(2**22), 1.0, 1.0, 0.0], 0), (301, [-float(2**22), 1.0, float(2**21), 0.0], 0), (302, [0.0, math.inf, 1.0, 1.0], 0)]
    d = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, VECTORS))
    got = rows_of(topk.op10_top_k(spark, d))
    assert got == sql_rows(topk.OP10_SQL, d) and {300, 301} & {r[3] for r in got}


def test_sums_beyond_64_bits_are_exact():
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.randint(0, 1 << rnd.choice([8, 40, 62])) for _ in range(5)]) for i in range(300)]
    index = topk.build_block(np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64))
    for query_id, q in [*rows[:30], (-1, [1, 0, -1, 2, 0]), (-2, [0] * 5)]:
        assert topk.search_block(index, query_id, np.array(q, np.int64), 5) == best(rows, query_id, q, 5)


def test_components_beyond_a_long_fail(spark):
    with pytest.raises(Exception, match="no long"):
        topk.integer_vectors(spark.createDataFrame([(1, [1e30], 0)], VECTORS)).collect()


def test_segments_are_added_in_few_rounds(monkeypatch):
    """Not one by one, which took the more calls the more blocks and queries there were."""
    rnd = np.random.default_rng(5)
    v = rnd.normal(0, 40, (3000, 32)).astype(np.int64)
    index, calls, sums = topk.build_block(np.arange(3000), v), [], topk._sums
    monkeypatch.setattr(topk, "_sums", lambda *a: calls.append(len(a[0])) or sums(*a))
    assert topk.search_block(index, 7, v[7], 5) == best(list(enumerate(v.tolist())), 7, v[7].tolist(), 5)
    assert 0 < len(calls) <= 2 * topk.ROUNDS and sum(calls) > 3000 and index["order"].flags.c_contiguous


def test_rounds_beyond_doubles_are_exact(monkeypatch):
    """Sums from 2^53 on, which doubles would round, but of 64 bits."""
    rnd = np.random.default_rng(6)
    v = rnd.integers(-(1 << 27), 1 << 27, (400, 6))
    index, calls, add = topk.build_block(np.arange(400), v), [], topk.score_all
    monkeypatch.setattr(topk, "score_all", lambda *a: calls.append(1) or add(*a))
    for q in range(0, 400, 9):
        assert topk.search_block(index, q, v[q], 5) == best(list(enumerate(v.tolist())), q, v[q].tolist(), 5)
    assert not calls
