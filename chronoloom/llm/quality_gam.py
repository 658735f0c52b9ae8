"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned; a look-up table gives each bin's part of the log odds. The tables are
learned by boosting shallow trees on one feature at a time, in turns, with a small rate, so that
features that go together share the credit. Pairs of features whose coarse grid explains most of what is
left then get tables of their own in the same way. A score is the intercept plus one addition for each
table, done for a batch of texts at once.

The model is fitted on the driver from a bounded sample of labelled rows; only their features are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Most labelled rows that a model is fitted on; of more, those of the smallest hashes.
TRAIN_ROWS = 20_000
#: Pairs of a label and a document of its key, which repeated keys multiply, that it is fitted on at most.
TRAIN_PAIRS = 4 * TRAIN_ROWS
#: Fold of held-out rows: crc32 of the id's text, modulo this, is 0.
FOLDS = 5
THRESHOLD = 0.3
BINS, GRID = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, LEAVES, MIN_HESSIAN = 0.1, 3, 2.0
#: Added to a cell's hessian sum, so that few rows can't give it a large value.
RIDGE = 1.0

FEATURES = (
    "log_words", "word_length", "upper", "digit", "space", "line", "period", "comma", "exclamation", "symbol", "bar", "other_mark",
    "accented", "distinct_words", "distinct_lines", "longest_word", "short_words", "marked_words",
)

_CLASS = np.full(256, 9, np.int64)  # other marks
for _i, _chars in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"#*$%&<>~^=")):
    _CLASS[list(_chars)] = _i
_CLASS[ord("|")] = 10
_CLASS[128:] = 11


def text_features(text: str) -> list[float]:
    """FEATURES of a whole text: logarithms, means and shares."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=12)
    total = max(len(data), 1)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    distinct = set(words)
    return [
        float(np.log1p(len(words))),
        (len(data) - by[3] - by[4]) / n,
        *(by[[1, 2, 3, 4, 5, 6, 7, 8, 10, 9, 11]] / total),
        len(distinct) / n,
        len(set(lines)) / len(lines),
        float(np.log1p(max(map(len, distinct), default=0))),
        sum(len(w) <= 3 for w in distinct) / max(len(distinct), 1),
        sum(not w.isalpha() for w in distinct) / max(len(distinct), 1),
    ]


@dataclass
class Model:
    """edges: by feature, the bins' upper limits. tables: by feature, each bin's value. pairs: of
    feature numbers, with coarse edges and a grid each."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for rows of features."""
        odds = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            odds += table[np.searchsorted(edges, x[:, f])]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            odds += grid[np.searchsorted(self.coarse[a], x[:, a]), np.searchsorted(self.coarse[b], x[:, b])]
        return 1 / (1 + np.exp(-odds))


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower")) if len(values) else np.zeros(0)


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """Each bin's step by the tree of at most ``leaves`` leaves over ordered bins, best splits first."""

    def gain(g, h):
        return g * g / (h + RIDGE)

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            g, h = np.cumsum(gradient[a:b]), np.cumsum(hessian[a:b])
            if b - a < 2:
                continue
            left, right = (g[:-1], h[:-1]), (g[-1] - g[:-1], h[-1] - h[:-1])
            gains = np.where((left[1] >= MIN_HESSIAN) & (right[1] >= MIN_HESSIAN), gain(*left) + gain(*right) - gain(g[-1], h[-1]), -1)
            cut = int(np.argmax(gains))
            if gains[cut] > best[0]:
                best = (gains[cut], (a, b), a + cut + 1)
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(gradient))
    for a, b in parts:
        step[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + RIDGE)
    return step


def _quadrants(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two-cut tree on a grid, one cut on each axis: its gain and each cell's step. Light
    quarters count too, held down by RIDGE alone: few rows are often all that an interaction has."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, hessian))
    n, m = gradient.shape
    best, step = -1.0, np.zeros((n, m))
    for i in range(1, n):
        for j in range(1, m):
            cells = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            sums = [(g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b, c, d in cells]
            total = sum(x * x / (y + RIDGE) for x, y in sums)
            if total > best:
                best = total
                for (a, b, c, d), (x, y) in zip(cells, sums, strict=True):
                    step[a:b, c:d] = x / (y + RIDGE)
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model for rows of features and labels 0 and 1. Without both labels it is constant: the
    share of label 1 with one row of each added."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    features = range(x.shape[1])
    edges = [bin_edges(x[:, f], BINS) for f in features]
    coarse = [bin_edges(x[:, f], GRID) for f in features]
    model = Model(intercept, edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(edges[f], x[:, f]) for f in features]
    odds = np.full(len(x), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in features:
            gradient, hessian = slopes()
            n = len(edges[f]) + 1
            step = RATE * _tree(np.bincount(bins[f], gradient, n), np.bincount(bins[f], hessian, n), LEAVES)
            model.tables[f] += step
            odds += step[bins[f]]
    cells = [np.searchsorted(coarse[f], x[:, f]) for f in features]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        at = cells[a] * shape[1] + cells[b]
        gradient, hessian = slopes()
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (gradient, hessian))

    gains = [(_quadrants(*grid(a, b)[1:])[0], a, b) for a in features for b in features if a < b and len(coarse[a]) and len(coarse[b])]
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for p, (a, b) in enumerate(model.pairs):
            at, gradient, hessian = grid(a, b)
            step = RATE * _quadrants(gradient, hessian)[1]
            model.grids[p] += step
            odds += step.ravel()[at]
    return model


def _with_features(rows: DataFrame, key: str) -> DataFrame:
    """key and f, the features of the column text; null counts as empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [text_features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(f, pa.list_(pa.float64()))], names=[key, "f"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, f array<double>")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, pairs: int = TRAIN_PAIRS) -> Model:
    """A model of labels (key, label 0 or 1) outside the held-out fold.

    Other labels, null ones and keys without a document take no part. A key with several labels or
    documents gives a row for each pair.

    rows: labels that are used at most, those of the smallest hashes. pairs: of them with their
    documents, which are more only where keys repeat, again those of the smallest hashes.
    """
    fit_for = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    sample = fit_for.orderBy(F.xxhash64("k", "y"), "k", "y").limit(rows)
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(sample), "k")  # at most ``rows`` of two integers
    found = _with_features(labelled.select(F.struct("k", "y").alias("ky"), "text"), "ky").select("ky.k", "ky.y", "f").orderBy(F.xxhash64("k", "y"), "k", "y", "f").limit(pairs).collect()
    x = np.array([r["f"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["y"] for r in found], float))


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1, higher: label 1 likelier) of each row's whole text.

    Null texts count as empty, which has a score like any text; null keys stay, repeated rows are
    each scored alike, an empty table gives none; other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t.as_py() or "") for t in batch.column("text")], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared.value.scores(x), pa.float64())], names=["key", "score"])

    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op5_quality_gam": op5_quality_gam}
ORACLES: dict[str, str] = {}
