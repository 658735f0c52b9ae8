import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, docs_of
from pyspark.sql import functions as F

from chronoloom.llm import near_dup as nd
from chronoloom.llm.common import WORD

RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 8))) for _ in range(3000)]


def prose(n):
    return [RND.choice(WORDS) for _ in range(n)]


def edited(words, edits):
    words = list(words)
    for _ in range(edits):
        i = RND.randrange(len(words) or 1)
        words[i : i + RND.randint(0, 1)] = [RND.choice(WORDS)] if RND.random() < 0.8 else []
    return words


def shingles(text):
    return nd.labelled_shingles(nd.words_of(text), nd.WordHashes())


def longest(a, b):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def similarity(a, b):
    m = longest(a, b)
    return m / (len(a) + len(b) - m)


def plain_classes(rows, candidates=None):
    """Least key of each row's component, all pairs compared, or those of the candidates."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    words = {i: t.split() for i, t in rows if t is not None}
    for (i, t), (j, u) in itertools.combinations(rows, 2):
        if t is None or u is None or find(i) == find(j):
            continue
        n, m = len(words[i]), len(words[j])
        near = candidates is None or candidates(t, u)
        if t == u or (min(n, m) and near and n * 0.8 <= m <= n / 0.8 and similarity(words[i], words[j]) >= 0.8 - 1e-12):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i, _ in rows}


def share_a_band(cache={}):
    def sketch(t):
        if t not in cache:
            cache[t] = nd.order_sketches(shingles(t)) if t.split() else np.zeros(0)
        return cache[t]

    return lambda t, u: bool((sketch(t) == sketch(u)).any()) if t.split() and u.split() else False


def assert_between(got, least, most):
    """Classes join what ``least`` joins, and nothing that ``most`` doesn't."""
    assert all(got[i] == got[least[i]] for i in got) and all(most[i] == most[got[i]] for i in got)


def test_words_are_split_at_six_characters():
    text = "a\x1cb c\x85d\u3000e\tf\x0bg\x0ch\r\ni\u2028j\xa0k"
    assert [w.decode() for w in nd.words_of(text)] == re.findall(WORD, text)


def test_alignment_matches_the_plain_table():
    for _ in range(400):
        base = prose(RND.randint(1, 60))
        if RND.random() < 0.3:
            base = base[:10] * 4
        a, b = ([w.encode() for w in edited(base, RND.randint(0, 8)) or ["x"]] for _ in range(2))
        assert nd.alike(a, b) == (similarity(a, b) >= 0.8 - 1e-12)
        assert nd.common_words(a, b, len(a) + len(b)) == longest(a, b)


def test_the_band_moves_along_long_texts():
    words = [w.encode() for w in prose(3000)]
    moved = words[:50] + words[60:1500] + [b"new"] * 7 + words[1500:]
    assert nd.common_words(words, moved, 10) == 2990 and nd.common_words(words, moved, 3) < 2990
    few = [RND.choice([b"a", b"b", b"c"]) for _ in range(400)], [RND.choice([b"a", b"b", b"c"]) for _ in range(380)]
    assert nd.common_words(*few, 400) == longest(*few) >= nd.common_words(*few, 5)


def test_shingles_are_labelled():
    s = shingles("a b c d e a b c d e a b c d e")
    assert len(s) == 11 == len(set(s.tolist()))
    assert len(shingles("a b")) == 1 and len(shingles(" \n")) == 0
    assert shingles("a b c d e f")[0] == shingles("a b c d e")[0]


def test_sketches_follow_order():
    words = prose(400)
    a, b = nd.order_sketches(shingles(" ".join(words))), nd.order_sketches(shingles(" ".join(edited(words, 4))))
    blocks = [words[i : i + 40] for i in range(0, 400, 40)]
    RND.shuffle(blocks)
    c = nd.order_sketches(shingles(" ".join(itertools.chain(*blocks))))
    assert (a == b).sum() >= 10 > (a == c).sum()


@pytest.mark.parametrize(("edits", "least"), [(22, 0.95), (20, 0.98), (10, 1.0)])
def test_bands_meet(edits, least):
    """Of 200 words every ninth, every tenth or every twentieth is another, at any places."""
    met = 0
    for _ in range(300):
        words = prose(200)
        other = list(words)
        for i in RND.sample(range(200), edits):
            other[i] = f"new{i}"
        met += bool((nd.order_sketches(shingles(" ".join(words))) == nd.order_sketches(shingles(" ".join(other)))).any())
    assert met >= least * 300


def test_parity_tables_differ_by_no_more_than_the_texts():
    hashes = nd.WordHashes()
    for _ in range(200):
        a, b = ([w.encode() for w in edited(prose(40) * 2, 20)] for _ in range(2))
        b = a[:30] + b[: RND.randint(0, 60)]
        differ = sum(x.bit_count() for x in (nd.parity(a, hashes) ^ nd.parity(b, hashes)).view(np.uint64).tolist())
        assert differ <= len(a) + len(b) - 2 * (Counter(a) & Counter(b)).total()
        assert not nd.alike(a, b) or 9 * differ <= len(a) + len(b)


def test_rarest_words_meet():
    """Alike texts share one of their rarest words, at places that the similarity allows."""
    rnd = random.Random(4)
    vocabulary = [b"%d" % int(rnd.paretovariate(0.7)) for _ in range(2000)]
    hashes, frequent = nd.WordHashes(), [b"1", b"2", b"3"]
    known = np.sort(nd.hashed(frequent, hashes).view(np.int64))
    counts, tried = np.array([30, 20, 10]), 0
    while tried < 200:
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        other = list(words)
        for _ in range(len(words) // 8):
            i = rnd.randrange(len(other))
            other[i : i + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [other[i], b"x"]])
        if not nd.alike(words, other):
            continue
        tried += 1
        a, b = (nd.rarest(w, hashes, known, counts).tolist() for w in (words, other))
        assert len(a) == len(words) // 5 + 1
        assert any(9 * (a.index(h) + b.index(h)) <= len(words) + len(other) for h in set(a) & set(b))


def test_classes_match_all_pairs(spark):
    rows = []
    for _ in range(25):
        base = prose(RND.randint(3, 90))
        for _ in range(RND.randint(1, 7)):
            rows.append(" ".join(edited(base, RND.randint(0, 6))))
    base = prose(100)  # a large group, chains included
    for _ in range(90):
        base_i = base if RND.random() < 0.5 else edited(base, 6)
        rows.append(" ".join(edited(base_i, RND.randint(0, 9))))
    passage = " ".join(prose(40))  # shared by texts that aren't alike
    rows += [passage + " " + " ".join(prose(60)) for _ in range(60)]
    rows += rows[:20] + ["", "", " ", None, None, "one", "one", "a b c d", "a b c d"]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r for r in nd.duplicate_classes(docs_of(spark, rows)).collect()}
    want = {i: r["class_id"] for i, r in got.items()}
    assert_between(want, plain_classes(rows, share_a_band()), plain_classes(rows, lambda t, u: len(set(shingles(t).tolist()) & set(shingles(u).tolist())) > 0))
    assert all(c <= i for i, c in want.items())
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    assert all(r["n_class"] == sizes[r["class_id"]] for r in got.values())
    kept = [r["doc_id"] for r in nd.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_chain_of_links_is_one_class(spark):
    words, rows = prose(120), []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = edited(words, 2)
    got = nd.duplicate_classes(docs_of(spark, rows)).collect()
    assert {r["class_id"] for r in got} == set(plain_classes(rows).values())


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (200, 201)]
    links = spark.createDataFrame([(b"%04d" % a, b"%04d" % b) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["label"]) for r in nd.connected(links).collect()}
    assert {got[b"%04d" % i] for i in range(1, 61)} == {b"0001"} and got[b"0102"] == b"0100" and got[b"0201"] == b"0200"


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, "only one text here and no other")]])
def test_without_candidates(spark, rows):
    docs = docs_of(spark, rows) if rows else spark.createDataFrame([], DOCS)
    assert [(r["doc_id"], r["class_id"]) for r in nd.duplicate_classes(docs).collect()] == [(i, i) for i, _ in rows]
    assert nd.keep_one(docs).count() == len(rows)


def test_null_and_repeated_keys(spark):
    text = " ".join(prose(30))
    docs = docs_of(spark, [(None, text), (5, text), (5, text), (5, "another text"), (None, "third text"), (None, "third text")]).withColumn("k", F.lit(1)).withColumn("_key", F.lit("x"))
    got = sorted(((r["doc_id"], r["class_id"], r["n_class"]) for r in nd.duplicate_classes(docs).collect()), key=str)
    assert got == sorted([(None, 5, 3), (5, 5, 3), (5, 5, 3), (5, 5, 1), (None, None, 2), (None, None, 2)], key=str)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, text), (5, "another text"), (None, "third text")], key=str)


def test_hashes_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(nd, "CACHED_WORDS", 3)
    words = [w.encode() for w in prose(40)]
    assert np.array_equal(shingles(" ".join(w.decode() for w in words)), nd.labelled_shingles(words, nd.WordHashes()))


def labels_of_one_bucket(spark, texts, hub):
    """Labels by text of a large bucket whose hub is given: it shares a second bucket with one more text."""
    texts = [*texts, " ".join(prose(50))]
    rows = [(1, b"%04d" % i, len(texts) - 1) for i in range(len(texts) - 1)] + [(2, b"%04d" % i, 2) for i in (hub, len(texts) - 1)]
    members = spark.createDataFrame(rows, "bucket long, print binary, size long")
    got = nd._labels(members, nd._texts(spark.createDataFrame([(b"%04d" % i, t) for i, t in enumerate(texts)], "print binary, text string")).persist())
    return {} if got is None else {int(bytes(r["node"])): int(bytes(r["label"])) for r in got.collect()}


def test_a_hub_that_covers_all_that_two_texts_share(spark):
    """The hub is longer than both, so neither is like it."""
    p = prose(120)
    texts = [" ".join(p + prose(2)), " ".join(p + prose(3)), " ".join(p + prose(80)), *(" ".join(prose(120)) for _ in range(40))]
    assert labels_of_one_bucket(spark, texts, 2) == {0: 0, 1: 0}


def test_blocks_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "FREQUENT", 50)
    p = prose(100)
    alike = [" ".join(p + prose(2)) for _ in range(5)] + [" ".join(p[:80] + prose(25)) for _ in range(4)]
    other = prose(100)
    long_hub = " ".join(p + prose(40) + other + prose(40))
    alike += [" ".join(other + prose(i)) for i in range(1, 4)]
    texts = [*alike, long_hub, *(" ".join(prose(100)) for _ in range(30))]
    got = labels_of_one_bucket(spark, texts, len(alike))
    want = plain_classes(list(enumerate(texts)))
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) > 30


def test_many_texts_of_shared_passages(spark):
    """Over a thousand texts put together from few passages, against all pairs of one band."""
    rnd = random.Random(5)
    passages = [prose(30) for _ in range(12)]
    rows = []
    for i in range(1100):
        chosen = sorted(rnd.sample(range(12), rnd.choice([3, 4, 5, 6])))
        rows.append((i, " ".join(itertools.chain(*(passages[c] for c in chosen), prose(rnd.randint(1, 25))))))
    words = [nd.words_of(t) for _, t in rows]
    sketches = np.array([nd.order_sketches(shingles(t)) for _, t in rows])
    classes = []
    for of_a_band in (True, False):
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i in range(len(rows)):
            near = (sketches[i + 1 :] == sketches[i]).any(axis=1) if of_a_band else np.ones(len(rows) - i - 1, bool)
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if find(i) != find(j) and nd.alike(words[i], words[j]):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        classes.append({i: find(i) for i in range(len(rows))})
    assert_between({r["doc_id"]: r["class_id"] for r in nd.duplicate_classes(docs_of(spark, rows)).collect()}, *classes)


def test_recall_on_a_corpus(spark, sf_dir):
    """All links between the texts of the corpus that have a rare run of five words in common."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    cls = {r["doc_id"]: r["class_id"] for r in nd.duplicate_classes(spark.createDataFrame(rows)).collect()}
    texts = {r["text"]: r["doc_id"] for r in rows}
    index = {}
    for t, i in texts.items():
        for s in set(shingles(t).tolist()):
            index.setdefault(s, []).append((i, t))
    pairs = {p for v in index.values() if len(v) <= 60 for p in itertools.combinations(sorted(v), 2)}
    links = [(i, j) for (i, t), (j, u) in pairs if nd.alike(nd.words_of(t), nd.words_of(u))]
    assert len(links) > 5 and sum(cls[i] == cls[j] for i, j in links) >= 0.9 * len(links)


def test_words_are_counted_over_all_texts(spark):
    """Against a plain count, by the hashes that the rarest words are looked up with, however texts are dealt."""
    words = ["a", "é", "中文", "🎉", "x" * 100, "nbsp\xa0kept", "\x1cword\x1f"]
    texts = [RND.choice(" \t\n\x0b\x0c\r").join(RND.choices(words, k=12)) + "\r \n" * (i % 2) for i in range(60)] + ["", " \n", "once"]
    plain = Counter(w for t in texts for w in set(re.findall(WORD, t)))
    hashes = nd.CountedHashes()
    want = {int(nd.hashed([w.encode()], hashes).view(np.int64)[0]): n for w, n in plain.items() if n > 1}
    for parts in (1, 30):
        known, counts = nd._frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        assert dict(zip(known.tolist(), counts.tolist(), strict=True)) == want and (np.diff(known) > 0).all()


def test_counting_words_makes_no_rows_by_task(spark, monkeypatch):
    """What counting brings to its aggregation depends on the texts, not on how many tasks they are dealt to."""
    texts = spark.createDataFrame([(" ".join(prose(50)),) for _ in range(40)], "text string")
    made = []
    for parts in (1, 20):
        plans = []
        with monkeypatch.context() as m:
            m.setattr(type(texts), "groupBy", lambda df, *by, whole=type(texts).groupBy: plans.append(df) or whole(df, *by))
            nd._frequent(texts.repartition(parts))
        made.append(plans[0].count())
    assert made[0] == made[1]
