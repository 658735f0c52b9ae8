import hashlib
import random
import tracemalloc

import pytest
from helpers import DOCS, EDGE_TEXTS, docs_of, saved
from tokenizers import Tokenizer

from chronoloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.production_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(bpe.production_path())


def made_texts(n=3000):
    rnd = random.Random(3)
    letters = ["a", "e", "th", "ing", "aaaa", "x", "Σ", "ß", "é", "é", "İ", "中", "🎉", " ", " ", "\x85", "\n", "'s", "'LL", "!!", "...", "12", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x00", "Ᲊ", "\U0001fae9", "ﬁ"]
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 20))) for _ in range(n)]
    return out + ["".join(chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(8)) for _ in range(n)]


def test_encoding_and_decoding_match_the_library(library, vocabulary, spark, sf_dir):
    encoder = bpe.Encoder(vocabulary)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + made_texts() + [t or "" for t in EDGE_TEXTS]
    for text, other in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = encoder.encode(text)
        assert ids == other.ids, text
        assert bpe.decode(ids, vocabulary) == library.decode(ids, skip_special_tokens=False)


def merged(word, merges):
    """Plain BPE: again and again the first of the earliest merge's pairs."""
    parts = list(word)
    while True:
        ranks = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
        if not ranks:
            return parts
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_matches_plain_bpe_for_random_merges():
    rnd = random.Random(7)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rnd.randint(1, 14)):
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        ids = {t: i for i, t in enumerate(tokens)}
        runner = bpe.Runner(bpe.compile_merges(range(3), [(ids[u], ids[v], ids[u + v]) for u, v in merges], len(tokens)))
        ranks = {p: i for i, p in enumerate(merges)}
        for _ in range(120):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            assert [tokens[t] for t in runner.run([ids[c] for c in word])] == merged(word, ranks), (merges, word)


def test_tables_start_anew(vocabulary):
    runner = bpe.Runner(vocabulary.automaton, most=3)
    symbols = [vocabulary.inner[b] for b in b"internationalisation"]
    first = runner.run(symbols)
    assert len(runner.sets) > 3 and runner.run(symbols) == first


def test_token_made_twice_is_refused():
    with pytest.raises(ValueError):
        bpe.compile_merges(range(2), [(0, 1, 2), (1, 0, 2)], 3)


def test_query(spark, tmp_path, library):
    texts = [*EDGE_TEXTS, "Hello  wörld 123", "Hello  wörld 123"]
    d = saved(spark, tmp_path, documents=docs_of(spark, [*enumerate(texts), (None, "x")]))
    got = bpe.op2_bpe(spark, d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = "x" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_batches_are_flushed_by_size(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 10)
    got = bpe.encode_documents(docs_of(spark, [(i, f"word number {i}") for i in range(50)]), bpe.production_path()).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(50)) and all(len(r["ids"]) >= 3 for r in got)


def test_empty_table_and_clashing_columns(spark):
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), bpe.production_path()).collect() == []
    odd = docs_of(spark, [(1, "a b")]).selectExpr("*", "1 AS ids", "'x' AS key", "2 AS decoded")
    [r] = bpe.encode_documents(odd, bpe.production_path()).collect()
    assert r["decoded"] == "a</w> b</w>"


def test_codes_alone_are_the_same_codes(spark):
    docs = docs_of(spark, [*enumerate([*EDGE_TEXTS, "Hello  wörld <|endoftext|> 123"]), (None, "x")])
    both, alone = bpe.encode_documents(docs, bpe.production_path()), bpe.encode_documents(docs, bpe.production_path(), decoded=False)
    assert alone.columns == ["doc_id", "ids"]
    assert sorted(map(tuple, alone.collect()), key=repr) == sorted(map(tuple, both.drop("decoded").collect()), key=repr)


def test_known_sets_are_small(vocabulary):
    """Each worker holds up to KNOWN_SETS of them. With numbers and steps they took 514 bytes a set as tuples, now 234."""
    rnd = random.Random(11)
    runner = bpe.Runner(vocabulary.automaton)
    tracemalloc.start()
    for _ in range(3000):
        runner.run([vocabulary.inner[rnd.choice(b"abcdefghijklmnopqrstuvwxyz")] for _ in range(8)])
    held = sum(x.size for x in tracemalloc.take_snapshot().filter_traces([tracemalloc.Filter(True, bpe.__file__)]).statistics("filename"))
    tracemalloc.stop()
    assert held < 400 * len(runner.sets)
