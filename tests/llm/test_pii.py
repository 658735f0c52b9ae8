import hashlib
import random
import re

import pytest
from helpers import DOCS, EDGE_TEXTS, docs_of, saved

from chronoloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain_spans(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def made_texts(n=4000):
    rnd = random.Random(9)
    bits = ["a", "b.c", "@", "x-y", ".", "1", "22", "255", "256", "0001", ".1.2.3", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "+", " ", "-", "(", "é", "٣", "@d.e", "%", "1.2.3.4.5", "\n"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_base_spans_match_plain_search(sf_dir, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t in texts + EDGE_TEXTS + made_texts():
        assert sorted(pii.detect(t or "")) == sorted(plain_spans(t)), t


def test_query_digests(spark, tmp_path):
    texts = made_texts(60) + [None, ""]
    d = saved(spark, tmp_path, documents=docs_of(spark, list(enumerate(texts))))
    for r in pii.op9_pii(spark, d).collect():
        base = sorted(plain_spans(texts[r["doc_id"]]))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write jane [at] mail (dot) example.com now", [("email", "jane [at] mail (dot) example.com")]),
        ("write jane dot doe at example dot com now", [("email", "jane dot doe at example dot com")]),
        ("jаne@exаmple.com", [("email", "jаne@exаmple.com")]),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", [("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
        ("ja​ne@example.com ok", [("email", "ja​ne@example.com")]),
        ("call plus one five five five zero one zero nine nine nine nine today", [("phone", "plus one five five five zero one zero nine nine nine nine")]),
        ("card ４１１１ １１１１ １１１１ １１１１.", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("host ١٠.٠.٠.١ up", [("ip", "١٠.٠.٠.١")]),
    ],
)
def test_disguises_map_back(text, found):
    base, more = pii.personal_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in more] == found


@pytest.mark.parametrize("text", ["meet at example.com tomorrow", "one two three", "look at this (at) home", "a dot here and a dot there", "naïve façade 中文字 2024", "at dot at dot", "one one one one one one one times the others"])
def test_clean_text_is_left_alone(text):
    assert pii.personal_spans(text) == ([], [])


def test_added_spans_hold_base_spans_or_are_apart():
    for t in made_texts(1500):
        base, more = pii.personal_spans(t + " zero one two three four five six seven")
        assert all(b <= c or d <= a or (a <= c and d <= b and (a, b) != (c, d)) for _, a, b in more for _, c, d in base)


def test_long_texts_are_linear():
    text = "1" * 200_000 + " " + "a" * 200_000 + "@" + " b@c.de " + "one " * 30_000
    base, _ = pii.personal_spans(text)
    assert [k for k, _, _ in base] == [0]
    assert len(pii.personal_spans("a" * 300_000 + " [at] me (dot) com")[1]) == 1


def test_empty_and_repeated(spark):
    assert pii.find_personal(spark.createDataFrame([], DOCS)).collect() == []
    got = pii.find_personal(docs_of(spark, [(None, "a@b.cd"), (1, ""), (1, "")])).collect()
    assert sorted((str(r["doc_id"]), len(r["base"])) for r in got) == [("1", 0), ("1", 0), ("None", 1)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("ping 192[.]168[.]1[.]1 now", "ip", "192[.]168[.]1[.]1"),
        ("ping 192 dot 168 dot 1 dot 1 now", "ip", "192 dot 168 dot 1 dot 1"),
        ("ping 192 (dot) 168.1.1 now", "ip", "192 (dot) 168.1.1"),
        ("ping one nine two dot one six eight dot one dot one now", "ip", "one nine two dot one six eight dot one dot one"),
        ("ping 10.0.zero[.]one now", "ip", "10.0.zero[.]one"),
        ("call +1 555 010 one two three four today", "phone", "+1 555 010 one two three four"),
        ("call +1 (555) zero one zero, 1234 today", "phone", "+1 (555) zero one zero, 1234"),
        ("call plus one 555 010 9999 today", "phone", "plus one 555 010 9999"),
        ("card 4111 1111 one one one one 1111.", "card", "4111 1111 one one one one 1111"),
        ("card four one one one 1111-1111-one one one one.", "card", "four one one one 1111-1111-one one one one"),
    ],
)
def test_partly_disguised_numbers(text, kind, found):
    base, more = pii.personal_spans(text)
    assert (base, [(pii.KINDS[k], text[a:b]) for k, a, b in more]) == ([], [(kind, found)])


@pytest.mark.parametrize("text", ["300 dot 1 dot 1 dot 1", "4111 1111 one one one one 1112", "4111 1111 one one one one 1111 1111", "in 2024 one of 12 or one dot", "version 1 dot 2 dot 3", "on 2024-01-15 one two", "10,000,000 and one"])
def test_other_numbers_are_left_alone(text):
    assert pii.personal_spans(text) == ([], [])


def test_long_runs_are_linear():
    text = "1 one " * 30_000 + "1[.]" * 50_000 + "1" + " " * 100_000 + "one dot " * 30_000 + "2" * 100_000
    pii.personal_spans(text)
