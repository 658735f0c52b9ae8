"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are turned into integers, floor(scale * x), and packed into index blocks of a bounded number
of vectors. In a block, each dimension's postings are ordered by value and cut into segments of one
quantised level. For a query, a posting's impact is q_d * x_d above the least such value of its
dimension, so it is never negative, whatever the signs. Segments are taken by descending impact
ceiling; each adds its impact floor to the accumulators of its vectors. What a vector may still gain
is bounded by the dimensions' quantisation slack or by the ceiling of their next segment. Processing
stops only on proof: every vector whose accumulator plus that bound reaches the k-th best exact score
known so far is a possible member and is rescored exactly, all others are provably below. The blocks'
results are merged by score and id. Where a block's sums for a query could pass 64 bits, its vectors are
all scored instead, those of large products with Python's integers.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

SCALE = 256
BLOCK = 16_384
QUERY_BLOCK = 2_048
LEVELS = 16
#: Times that a search asks whether it may stop; between them, segments are added together.
ROUNDS = 8
#: Doubles hold all integers up to this.
EXACT = float(1 << 53)
#: Sums below this, with room for the few that are added to each other, are safe in 64 bits.
SAFE = float(1 << 60)


def build_block(ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> dict[str, np.ndarray]:
    """The index of one block: for each dimension the vectors' order by value, where each level's
    segment starts in it, and the least and greatest value in each segment."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
    ranked = np.take_along_axis(vectors.T, order, axis=1)
    low, high = ranked[:, :1], ranked[:, -1:]
    if np.abs(ranked.astype(float)).max(initial=0) * levels < SAFE:
        quantised = (ranked - low) * levels // (high - low + 1)
    else:  # any levels that rise with the values will do
        span = np.maximum(high.astype(float) - low, 1)
        quantised = np.minimum((ranked.astype(float) - low) / span * levels, levels - 1).astype(np.int64)
    starts = np.stack([np.searchsorted(row, np.arange(levels + 1)) for row in quantised]) if dims else np.zeros((0, levels + 1), np.int64)
    first = np.take_along_axis(ranked, np.minimum(starts[:, :-1], n - 1), axis=1)
    last = np.take_along_axis(ranked, np.maximum(starts[:, 1:] - 1, 0), axis=1)
    order = np.ascontiguousarray(order)  # a dimension's postings lie side by side
    return {"ids": ids, "vectors": vectors, "order": order, "starts": starts, "first": first, "last": last}


def score_all(index: dict[str, np.ndarray], query_id: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    """search_block() of any components, all vectors scored."""
    ids, vectors = index["ids"], index["vectors"]
    large = np.abs(vectors.astype(float)) @ np.abs(weights.astype(float)) >= SAFE
    scores = (np.where(large[:, None], 0, vectors) @ weights).astype(object)
    scores[large] = vectors[large].astype(object) @ weights.astype(object)
    best = heapq.nsmallest(k, ((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != query_id))
    return [(i, -s) for s, i in best]


def _sums(places: np.ndarray, gains: np.ndarray, n: int) -> np.ndarray:
    """The sum of the gains, none negative, at each of n places. Doubles hold them exactly below 2^53."""
    if float(gains.max(initial=0)) * len(gains) < EXACT:
        return np.bincount(places, gains, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, places, gains)
    return out


def search_block(index: dict[str, np.ndarray], query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of one block for one query; rows of the query's id take no part."""
    ids, vectors, order, starts = index["ids"], index["vectors"], index["order"], index["starts"]
    n, dims = vectors.shape
    weights = np.zeros(dims, np.int64)
    weights[: min(dims, len(query))] = query[:dims]
    allowed = ids != query_id
    if not allowed.any():
        return []
    most = np.maximum(np.abs(index["first"][:, 0].astype(float)), np.abs(index["last"][:, -1].astype(float))) if dims else np.zeros(0)
    if most @ np.abs(weights.astype(float)) >= SAFE / 4:
        return score_all(index, query_id, weights, k)
    counts = np.diff(starts, axis=1)
    either = np.stack([index["first"] * weights[:, None], index["last"] * weights[:, None]])
    floor, ceiling = either.min(axis=0), either.max(axis=0)
    least = np.where(counts > 0, floor, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) if dims else np.zeros(0, np.int64)
    floor, ceiling = floor - least[:, None], ceiling - least[:, None]
    live = (counts > 0) & (weights != 0)[:, None]
    slack = np.where(live, ceiling - floor, 0).max(axis=1, initial=0)
    at_dim, at_level = np.nonzero(live)
    by_impact = np.argsort(-ceiling[at_dim, at_level], kind="stable")
    at_dim, at_level = at_dim[by_impact], at_level[by_impact]
    ceilings = ceiling[at_dim, at_level]
    following = np.zeros(len(at_dim), np.int64)  # ceiling of the dimension's next segment
    upcoming = np.zeros(dims, np.int64)
    own = np.argsort(at_dim, kind="stable")  # each dimension's segments in turn, by impact
    same = at_dim[own][1:] == at_dim[own][:-1]
    following[own[:-1][same]] = ceilings[own[1:][same]]
    leading = own[np.append(True, ~same)[: len(own)]]
    upcoming[at_dim[leading]] = ceilings[leading]
    bound = np.maximum(slack, upcoming)
    base = int(least[weights != 0].sum())
    acc = np.zeros(n, np.int64)
    flat, gains = order.reshape(-1), floor[at_dim, at_level]
    begins, sizes = at_dim * n + starts[at_dim, at_level], counts[at_dim, at_level]
    ends = begins + sizes
    nows = np.maximum(slack[at_dim], following)
    possible = np.flatnonzero(allowed)
    for at in range(0, len(at_dim), max(1, len(at_dim) // ROUNDS)):
        taken = slice(at, at + max(1, len(at_dim) // ROUNDS))
        some = np.flatnonzero(gains[taken]) + at
        if len(some):
            postings = np.concatenate([flat[i:j] for i, j in zip(begins[some].tolist(), ends[some].tolist(), strict=True)])
            acc += _sums(postings, np.repeat(gains[some], sizes[some]), n)
        # A dimension's last segment of the round says what it may still add.
        bound[at_dim[taken]] = nows[taken]
        rest = int(bound.sum())
        shown = np.where(allowed, acc, -1)
        best = np.argpartition(shown, n - k)[n - k :] if n > k else np.arange(n)
        best = best[allowed[best]]
        exact = np.sort(vectors[best] @ weights)
        if len(exact) >= k:
            possible = np.flatnonzero(allowed & (acc + (rest + base) >= exact[-k]))
            if len(possible) <= max(4 * k, n // 16):
                break
    scores = vectors[possible] @ weights
    if len(possible) > 8 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        possible, scores = possible[keep], scores[keep]
    top = np.lexsort((ids[possible], -scores))[:k]
    return [(int(ids[possible[i]]), int(scores[i])) for i in top]


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _dense(lists: list[np.ndarray]) -> np.ndarray:
    dims = max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v, the components floor(scale * x) of each vector that takes part: of no null or
    non-finite component. A finite one whose integer is no long is an error, as in SQL."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fit = F.col(id_col).isNotNull() & v.isNotNull() & finite

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        fits = (scaled >= -(2.0**63)) & (scaled < 2.0**63)
        return F.when(fits, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a vector's integer component is no long")).cast("long"))

    return table.where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("v"))


def build_index(vectors: DataFrame, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """One row, ``index`` binary, for each block of at most ``block`` of (id, v); no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == block:
                    yield flush(ids, rows)
                    ids, rows = [], []
        if ids:
            yield flush(ids, rows)

    def flush(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        data = _pack(build_block(np.array(ids, np.int64), _dense(rows), levels))
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["index"])

    return vectors.mapInArrow(pack, "index binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best vectors by integer inner
    product, ties to the smaller id.

    vectors and queries are (id long, v array<long>), as integer_vectors() makes them: ids and
    vectors that are null, or hold null or non-finite components, take no part. Scores are exact; one of
    the best that is no long is an error. A vector
    shorter than the query counts as filled up with zeros. Rows that bear the query's id are no
    candidates for it. Repeated candidate rows are candidates each; repeated query rows are one
    query; different query vectors of one id are ranked apart. With fewer than k candidates all are
    returned, and none from an empty table.

    Work is (index block, query block) pairs: a task holds one of each, of bounded size. Each yields
    at most k rows a query, cut to k a query again before the final shuffle.
    """
    distinct = queries.select("id", "v").dropDuplicates(["id", "v"])
    blocks = max(1, -(-distinct.count() // query_block))
    packed = distinct.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("qb")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    packed = F.broadcast(packed) if blocks <= 8 else packed  # 8 blocks are 16,384 queries at most
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = build_index(vectors, block).repartition(parts).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = index.join(packed, "qb").select("index", "queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, asked in zip(batch.column("index"), batch.column("queries"), strict=True):
                parsed = _unpack(data.as_py())
                parsed["order"] = parsed["order"].astype(np.intp)  # once, not for each query
                out: list[tuple[int, str, int, int]] = []
                for q in asked.as_py():
                    found = search_block(parsed, q["id"], np.array(q["v"], np.int64), k)
                    key = ",".join(map(str, q["v"]))
                    out += [(q["id"], key, i, s) for i, s in found]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "query", "vec_id", "score"])

    found = pairs.mapInArrow(score, "query_id long, query string, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


OP10_SQL = f"""
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {"op10_top_k": op10_top_k}
ORACLES = {"op10_top_k": OP10_SQL}
