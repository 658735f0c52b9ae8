"""Near-duplicate texts by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with how often it came before. Order
MinHash takes, for each band, the two labelled shingles of smallest hash and keeps them in text order;
texts that agree in a band share a bucket. So candidates need equal pieces in equal order, which
follows edit similarity, not just common content.

A candidate pair is verified by alignment: the longest common subsequence of the texts' words, looked for
within the band of shifts that the similarity allows. Its length M makes the similarity
M / (n_a + n_b - M); 0.8 or more is a link: with M no less than 4/9 of both texts' words, up to every ninth
word may be another. Classes are the links' connected components.

No bucket is expanded into all pairs. Equal texts are one node from the start. In each bucket every
member is compared with a hub, the member whose buckets are largest: in a group of copies, mostly the
text they were made from. Buckets whose members are then one class are done. What is left of small
buckets is compared pair by pair. In a large one of which a class has most, the others are compared with
one more of that class, another in each bucket. The texts of what is still left are dealt once, however
many buckets they are in, by their rarest words: alike texts share four fifths of their words, occurrences
counted, so of the rarest fifth and one more they must share one. Texts that do, are of different
classes and have no more rarer words than the similarity allows are compared.

Before two texts of which none is a hub are brought together, their parity tables are: each labelled word
turns one of 1,024 bits over, so two tables differ in no more bits than the texts have words that the other lacks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, discard, free_prefix, hinted, read, running_sum

SHINGLE = 5
#: Bands, and minima in each. Of texts alike to the limit (every ninth word another) some 0.38 of the
#: shingles agree, so a band does with chance 0.15 and one of all with 0.98; of 0.9, with 0.998.
BANDS, MINIMA = 24, 2
#: Members up to which what a hub leaves of a bucket is compared pair by pair.
SMALL = 24
#: Texts of a block, of which a task compares two, and the frequent words whose counts each task knows.
BLOCK, FREQUENT = 256, 20_000
#: 64-bit words of a text's parity table, and the rarer words of a text that come with each of its rarest.
PARITY, RARER = 16, 16
#: Distinct words whose hashes a task keeps at once, and the hashes that are permuted at once.
CACHED_WORDS, AT_ONCE = 150_000, 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT, _LAST = np.uint64(31), np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _B
    x = (x ^ (x >> _SHIFT)) * _C
    return x ^ (x >> _SHIFT)


class WordHashes(dict):
    """64-bit hashes of words, of which a bounded number are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class CountedHashes(WordHashes):
    """Those of Spark's xxhash64."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def words_of(text: str) -> list[bytes]:
    """The text's words in UTF-8. Bytes are split at just the six characters between words."""
    return text.encode().split()


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes with the number of earlier equal ones mixed in, all distinct."""
    ranked = np.sort(s)
    if (ranked[1:] != ranked[:-1]).all():
        return s
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    label = np.empty(len(s), np.uint64)
    label[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return np.where(label > 0, _mix(s + label * _A), s)


def labelled_shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hashes of the labelled shingles in text order.

    A text of fewer words than a shingle has one of all its words; one without words has none.
    """
    if not words:
        return np.zeros(0, np.uint64)
    w = hashed(words, hashes)
    size = min(SHINGLE, len(w))
    s = np.full(len(w) - size + 1, np.uint64(size))
    for j in range(size):
        s = s * _A + w[j : len(w) - size + 1 + j]
    return labelled(_mix(s))


def order_sketches(s: np.ndarray, bands: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """For each band the hash of the shingles of smallest permuted hash, in text order.

    Hashes are mixed already, so a product with an odd number of the band's own permutes them.
    """
    n, k = len(s), min(minima, len(s))
    factors = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _A) | np.uint64(1)
    out = np.empty(bands, np.uint64)
    step = max(1, AT_ONCE // n)
    for b in range(0, bands, step):
        permuted = s[None, :] * factors[b : b + step, None]
        row, at = np.arange(len(permuted)), np.empty((len(permuted), k), np.int64)
        for j in range(k):
            at[:, j] = permuted.argmin(axis=1)
            permuted[row, at[:, j]] = _LAST
        chosen, h = s[np.sort(at, axis=1)], np.full(len(permuted), np.uint64(k))
        for j in range(k):
            h = _mix(h * _A + chosen[:, j])
        out[b : b + step] = h
    return out.view(np.int64)


def parity(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The parity table of the labelled words."""
    s = labelled(_mix(hashed(words, hashes)))
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_edits(total: int) -> int:
    """Words of either text, of ``total`` of both, that alike texts may have and the other not."""
    return total // 9


def common_words(a: list[bytes], b: list[bytes], band: int) -> int:
    """Length of the longest common subsequence of which no pair is shifted by more than band.

    Bit i of ``row`` is 0 where the subsequence with a's first i + 1 words is longer than with i. A word
    of b changes all bits at once; those that have left the band are counted and dropped.
    """
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    found, base, row, whole = head + tail, 0, (1 << len(a)) - 1, (1 << len(a)) - 1
    for j, word in enumerate(b):
        if at := places.get(word):
            if j - base > 2 * band + 64:
                gone = j - band - base
                found += gone - (row & (1 << gone) - 1).bit_count()
                row, whole, base = row >> gone, whole >> gone, base + gone
            low = max(j - band - base, 0)
            hit = row & at >> base + low << low & (1 << max(j + band + 1 - base, 0)) - 1
            row = (row + hit | row - hit) & whole
    return found + whole.bit_length() - row.bit_count()


def alike(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the banded alignment of two lists of words reaches the similarity."""
    total = len(a) + len(b)
    if 9 * min(len(a), len(b)) < 4 * total:
        return False
    if 9 * (Counter(a) & Counter(b)).total() < 4 * total:
        return False
    return 9 * common_words(a, b, most_edits(total)) >= 4 * total


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, print (MD5 of the text) and sketches of (doc_id, text), text not null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            prints, sketches = [], []
            for t in batch.column("text"):
                text = t.as_py().encode()
                s = labelled_shingles(text.split(), hashes)
                prints.append(hashlib.md5(text).digest())
                sketches.append(order_sketches(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "print", "sketches"])

    return docs.mapInArrow(run, f"doc_id {kind}, print binary, sketches array<bigint>")


def _texts(texts: DataFrame) -> DataFrame:
    """print, text, n (words) and odd (the parity table) of (print, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, odd = [], []
            for t in batch.column("text"):  # a text's words at a time, not those of all the batch
                words = words_of(t.as_py())
                n.append(len(words))
                odd.append(parity(words, hashes))
            yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("text"), pa.array(n, pa.int64()), pa.array(odd, pa.list_(pa.int64()))], names=["print", "text", "n", "odd"])

    return texts.mapInArrow(run, "print binary, text string, n bigint, odd array<bigint>")


def _may_be_alike() -> Column:
    """Of texts a and b, by n and odd."""
    both = F.col("n_a") + F.col("n_b")
    apart = sum((F.bit_count(F.get("odd_a", F.lit(i)).bitwiseXOR(F.get("odd_b", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    return (9 * F.least("n_a", "n_b") >= 4 * both) & (9 * apart <= both)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b), a written table, that are alike.

    Texts are shuffled twice for it: only those that are in a pair, where a broadcast may name them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for x, y, b in zip(batch.column("ta"), batch.column("tb"), batch.column("b"), strict=True):
                if last is None or b.as_py() != last[0]:
                    last = b.as_py(), words_of(y.as_py())
                keep.append(alike(words_of(x.as_py()), last[1]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct())
    if ends.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ends), "print", "left_semi")
    joined = pairs.join(texts.select(F.col("print").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("print").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def connected(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for all nodes of links (a, b).

    Each round takes the smallest label among a node and its neighbours, then that label's own, so
    labels travel twice as far each time. Labels are written each round; it ends when none changes.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        reach = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = reach.join(labels, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(moved.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")))
        discard(labels)
        labels = new
        if new.where(F.col("old") != F.col("label")).isEmpty():
            discard(edges)
            return labels


def _members(buckets: DataFrame) -> DataFrame:
    """bucket, print and size, for buckets of two or more of (bucket, print), each pair distinct."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    return cut(buckets.join(sizes, "bucket"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """labels (node, label) after more links (a, b), of which only those between components count."""
    if labels is None:
        return None if links.isEmpty() else connected(links)
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce(f"label_{end}", end)).drop(f"label_{end}")
    between = cut(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    if between.isEmpty():
        return labels
    joined = connected(between)
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    out = cut(moved.unionByName(fresh.select("node", "label")))
    discard(labels, between, joined)
    return out


def _mixed(members: DataFrame, labels: DataFrame | None, group: str = "bucket") -> DataFrame:
    """members with ``label`` as it is now, a text without one its own, where a group's labels differ."""
    named = members.withColumn("label", F.col("print"))
    if labels is not None:
        named = members.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    named = cut(named)
    mixed = named.groupBy(group).agg(F.min("label").alias("least"), F.max("label").alias("most")).where(F.col("least") != F.col("most")).select(group)
    out = cut(named.join(mixed, group))
    discard(named)
    return out


def _small_pairs(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """a and b of different labels within the small of the mixed buckets that may be alike."""
    few = mixed.where((F.col("size") <= SMALL) & (F.col("print") != F.col("hub"))).join(texts.select("print", "n", "odd"), "print")
    left, right = (few.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("print", "label", "n", "odd"))) for x in "ab")
    pairs = left.join(right, "bucket").where((F.col("print_a") < F.col("print_b")) & (F.col("label_a") != F.col("label_b")) & _may_be_alike())
    return pairs.select(F.col("print_a").alias("a"), F.col("print_b").alias("b"))


def _second_hubs(large: DataFrame) -> DataFrame:
    """a, and b of the class that most of a large bucket are of, another b in each bucket."""
    parts = large.groupBy("bucket", "label", "size").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bucket", "print"), "print")).alias("one"))
    most = parts.where(2 * F.col("n") >= F.col("size")).select("bucket", F.col("label").alias("lb"), F.col("one.print").alias("b"))
    return large.join(most.groupBy("bucket").agg(F.min(F.struct("lb", "b")).alias("m")), "bucket").where(F.col("label") != F.col("m.lb")).select(F.col("print").alias("a"), F.col("m.b").alias("b"))


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (CountedHashes), sorted, and counts of the FREQUENT words that most texts have.

    Spark counts: each text's different words are a row each, as many as there are, however the texts are dealt.
    """
    words = F.array_remove(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+")), "")
    counts = texts.select(F.explode(words).alias("word")).groupBy(F.xxhash64("word").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = sorted((r["h"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "h").limit(FREQUENT).collect())
    table = np.array(rows, np.int64).reshape(-1, 2)
    return table[:, 0], table[:, 1]


def rarest(words: list[bytes], hashes: WordHashes, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of the labelled words, rarest first, of which an alike text has one: a fifth and one more.

    The order is the same for all texts: by the words' counts, then by hash.
    """
    w = hashed(words, hashes)
    at = np.searchsorted(known, w.view(np.int64))
    found = (at < len(known)) & (np.take(known, at, mode="clip") == w.view(np.int64)) if len(known) else np.zeros(len(w), bool)
    count = np.where(found, np.take(counts, at, mode="clip"), 0) if len(known) else np.zeros(len(w), np.int64)
    s = labelled(_mix(w))
    return s[np.lexsort((s, count))[: len(s) // 5 + 1]]


def _rare_pairs(large: DataFrame, texts: DataFrame) -> DataFrame:
    """a and b, each pair once, that may be alike, of different labels and both in large buckets.

    Texts are grouped by each of their rarest words; groups are cut into blocks in the order of labels,
    and each two blocks, but those of one and the same label, are a key of the join.
    """
    held = cut(large.select("print", "label").distinct())
    n_held = held.count()
    own = cut(texts.join(hinted(held, n_held), "print"))
    known, counts = _frequent(own.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = CountedHashes()
        for batch in batches:
            s = [rarest(words_of(t.as_py()), hashes, known, counts) for t in batch.column("text")]
            size = np.array([len(x) for x in s])
            row, h = np.repeat(np.arange(len(s)), size), np.concatenate(s).view(np.int64)
            start = np.repeat(np.cumsum(size) - size, size)
            place = np.arange(len(h)) - start
            before = np.minimum(place, RARER)
            ends = np.cumsum(before)
            rarer = h[np.repeat(start - (ends - before), before) + np.arange(ends[-1])]
            rarer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rarer))
            yield pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(row)), pa.array(h), pa.array(place), rarer], names=["print", "h", "place", "rarer"])

    rare = own.select("print", "text").mapInArrow(run, "print binary, h bigint, place bigint, rarer array<bigint>")
    sizes = cut(rare.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    dealt = cut(rare.join(sizes, "h").join(hinted(own.drop("text"), n_held), "print"))
    few, many = dealt.where(F.col("size") <= BLOCK), dealt.where(F.col("size") > BLOCK)
    numbered = running_sum(many.withColumn("one", F.lit(1)), ["h"], [F.col("label"), F.col("print")], "one", "at")
    placed = cut(numbered.withColumn("block", F.floor(F.col("at") / BLOCK)).drop("at", "one"))
    blocks = placed.groupBy("h", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    i, j = (blocks.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("block", "least", "most"))) for x in "ij")
    tasks = cut(i.join(j, "h").where((F.col("block_i") <= F.col("block_j")) & ((F.col("least_i") != F.col("most_j")) | (F.col("most_i") != F.col("least_j")))).select("h", "block_i", "block_j"))
    columns = ("print", "label", "place", "rarer", "n", "odd")

    def side(rows: DataFrame, x: str, *others: str) -> DataFrame:
        return rows.select("h", *others, *(F.col(c).alias(f"{c}_{x}") for c in columns))

    edits = 9 * (F.col("place_a") + F.col("place_b")) <= F.col("n_a") + F.col("n_b")
    first = ~F.arrays_overlap("rarer_a", "rarer_b")  # else the pair is found by a rarer word
    near = edits & (F.col("label_a") != F.col("label_b")) & _may_be_alike() & first
    ordered = F.col("print_a") < F.col("print_b")
    found = side(few, "a").join(side(few, "b"), "h").where(ordered & near)
    a, b = (side(placed.withColumnRenamed("block", end), x, end).join(tasks, ["h", end]) for x, end in (("a", "block_i"), ("b", "block_j")))
    further = a.join(b, ["h", "block_i", "block_j"]).where(((F.col("block_i") < F.col("block_j")) | ordered) & near)
    pairs = cut(found.select("print_a", "print_b").unionByName(further.select("print_a", "print_b")).toDF("a", "b").distinct())
    discard(own, sizes, dealt, placed, tasks)
    return pairs


def _labels(members: DataFrame, texts: DataFrame) -> DataFrame | None:
    """node and label of the texts with a link, label the same for what is connected; None if there
    is none. members: bucket, print, size; texts: print, text, n, odd."""
    drawn = members.groupBy("print").agg(F.sum("size").alias("drawn"))
    hubs = members.join(drawn, "print").groupBy("bucket").agg(F.max_by("print", F.struct("drawn", "print")).alias("hub"))
    with_hub = cut(members.join(hubs, "bucket"))
    to_hub = with_hub.where(F.col("print") != F.col("hub")).select(F.col("print").alias("a"), F.col("hub").alias("b")).distinct()
    labels = _merged(None, cut(_verified(cut(to_hub), texts)))
    mixed = _mixed(with_hub, labels)
    discard(with_hub)
    large = mixed.where(F.col("size") > SMALL)
    further = cut(_small_pairs(mixed, texts).unionByName(_second_hubs(large)).distinct())
    labels = _merged(labels, cut(_verified(further, texts)))
    left = _mixed(large.drop("label"), labels)
    discard(mixed)
    if left.isEmpty():
        return labels
    return _merged(labels, cut(_verified(_rare_pairs(left, texts), texts)))


def _rows_of(docs: DataFrame, wanted: DataFrame, same: Column, times: str = "n_first") -> tuple[DataFrame, DataFrame]:
    """Rows of docs that wanted, a written table, names once by ``times``, and those that it names repeatedly.

    The first grow with docs and are joined by shuffle at every size. Few are repeated, and then broadcast,
    so that whole texts are shuffled once.
    """
    often = wanted.where(F.col(times) > 1)
    single = docs.join(wanted.where(F.col(times) == 1).hint("merge"), same, "left_semi")
    return single, docs.join(hinted(often, often.count()), same, "left_semi")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text), text not null: doc_id and print by row; and by print, the text's MD5: first
    (a struct that orders its keys, null last: without, key), n_first (its rows of that key), n (its
    rows) and label (the same for all texts of a class)."""
    rows = cut(_sketched(docs))
    first = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("key"))
    by_key = rows.groupBy("print", "doc_id").agg(F.count("*").alias("n"))
    nodes = cut(by_key.groupBy("print").agg(F.min(F.struct(first.alias("first"), F.col("n").alias("n_first"))).alias("f"), F.sum("n").alias("n")).select("print", "f.first", "f.n_first", "n"))
    one = rows.groupBy("print").agg(F.first("sketches").alias("sketches"))
    buckets = one.select("print", F.posexplode("sketches").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "print")
    members = _members(buckets)
    wanted = members.select("print").distinct().join(nodes.select("print", F.col("first.key").alias("key"), "n_first"), "print").withColumnRenamed("print", "p")
    wanted = cut(wanted)
    printed = docs.withColumn("print", F.unhex(F.md5("text")))
    same = F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("print") == F.col("p"))
    single, repeated = _rows_of(printed, wanted, same)
    texts = cut(_texts(single.unionByName(repeated.dropDuplicates(["print"])).select("print", "text")))
    discard(wanted)
    labels = _labels(members, texts)
    discard(members, texts)
    rows = rows.drop("sketches")
    if labels is None:
        return rows, nodes.withColumn("label", F.col("print"))
    labelled = nodes.join(labels.select(F.col("node").alias("print"), "label"), "print", "left")
    return rows, cut(labelled.withColumn("label", F.coalesce("label", "print")))


def duplicate_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id and n_class (rows of the class) of each row; class_id is the class's smallest key.

    Equal texts are one class, the empty text among them. Texts without words are alike only if equal,
    texts that have no five words in a row in common are no candidates.
    A row of null text is alone in a class of its own key. Null keys count as larger than all others; a
    class of null keys only has a null class_id. Repeated rows keep their rows. An empty table gives
    none; other columns are not read.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows, labelled = _labelled(slim.where(F.col("text").isNotNull()))
    classes = labelled.groupBy("label").agg(F.min("first")["key"].alias("class_id"), F.sum("n").alias("n_class"))
    by_print = labelled.join(classes, "label").select("print", "class_id", "n_class")
    known = rows.select("doc_id", "print").join(by_print, "print").select("doc_id", "class_id", "n_class")
    alone = slim.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"))
    return known.unionByName(alone).withColumnRenamed("doc_id", key)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each class, all columns: of the smallest key, null last.

    Of repeated rows of that key and text one stays, whichever other columns it has. Rows of null text
    all stay.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    _, labelled = _labelled(slim.where(F.col("text").isNotNull()))
    free = free_prefix(docs)
    chosen = labelled.groupBy("label").agg(F.min(F.struct("first", "print", "n_first")).alias("c")).select(F.col("c.first.key").alias(f"{free}key"), F.col("c.print").alias(f"{free}print"), F.col("c.n_first").alias(f"{free}n"))
    same = F.col(key).eqNullSafe(F.col(f"{free}key")) & (F.unhex(F.md5(F.col(text))) == F.col(f"{free}print"))
    without = docs.where(F.col(text).isNull())
    single, repeated = _rows_of(docs, cut(chosen), same, f"{free}n")
    return single.unionByName(repeated.dropDuplicates([key, text])).unionByName(without)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(read(spark, sf_dir, "documents"))


QUERIES = {"op3_near_dup": op3_near_dup}
ORACLES: dict[str, str] = {}
