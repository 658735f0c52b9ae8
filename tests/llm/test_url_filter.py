import pytest
from helpers import rows_of, saved, sql_rows

from chronoloom.llm import url_filter as u

PAGES = "page_id long, url string, html string"
URLS = [None, "", "no scheme", "http://", "://x/y", "http://Example.COM/en/7", "http://example.com/en/8?x", "https://a.example.net/de/8/1", "https://a.example.net/de/9", "http://notexample.com/en/7", "http://x.org/es/", "http://x.org#/es/", "http://x.org/fr/viagra", "http://cheap-pills.fr/", "http://cheap.fr/", "http://cheapest-pills.fr", "http://x.fr/a%20casino", "http://spam.fr?q", "HTTP://ÄX.fr/É://b", "http://u:p@h.net:80/de/x", "http://x.fr/" + "a" * 50_000, "a\nb://c\nd/e", "http://com/en/", "http://.com/en/"]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, x, None) for i, x in enumerate(urls)], PAGES)


def test_same_rows_as_sql(spark, tmp_path, sf_dir):
    assert rows_of(u.op6_url_filter(spark, sf_dir)) == sql_rows(u.OP6_SQL, sf_dir)
    d = saved(spark, tmp_path, pages=pages_of(spark, URLS))
    assert rows_of(u.op6_url_filter(spark, d)) == sql_rows(u.OP6_SQL, d)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("http://Example.COM/en/7?a#b", "example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://sub.other.com/en/x", "sub.other.com", "/en/x", "com/en/", "block"),
        ("http://a.example.net/de/88", "a.example.net", "/de/88", "example.net/de/8", "block"),
        ("http://a.example.net/de/9", "a.example.net", "/de/9", "net/de/", "allow"),
        ("http://badexample.net/de/8", "badexample.net", "/de/8", "net/de/", "allow"),
        ("http://x.fr/viagra", "x.fr", "/viagra", None, "block"),
        ("http://x.fr/viagras", "x.fr", "/viagras", None, "allow"),
        ("http://cheap.pills.fr/cheap", "cheap.pills.fr", "/cheap", None, "block"),
        ("http://cheap.fr/cheap", "cheap.fr", "/cheap", None, "allow"),
    ],
)
def test_verdicts(spark, url, host, path, rule, verdict):
    [r] = u.filter_urls(pages_of(spark, [url])).collect()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_terms_that_overlap_and_nest():
    automaton = u.compile_terms(("she",), ("he", "hers-a", "a"))
    assert u.term_hits("x.she.hers-a", automaton) == ({"she"}, {"hers-a", "a"})


def test_no_terms_no_rules_no_rows(spark):
    [r] = u.filter_urls(pages_of(spark, ["http://viagra.com/en/"]), (), (), ()).collect()
    assert r["verdict"] == "allow" and r["rule"] is None
    assert u.filter_urls(pages_of(spark, [])).collect() == []


def test_nulls_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame([(None, "http://a.fr/", "x", 1)] * 2, "page_id long, url string, verdict string, host int")
    assert [(r["page_id"], r["verdict"]) for r in u.filter_urls(pages).collect()] == [(None, "allow")] * 2


BAD = ("free-bets", "ads-track", "sexy-webcam", "payday-loans", "online-casinos", "cheap-replicas", "poker.slots", "x/keygens/torrents", "x/adult%2Ddating", "diet_pills")
CLEAN = ("track-record", "freedom-betterment", "adult-education", "credit-union", "essex-farms", "pharmacology", "win32-docs", "x/casinoesque", "x/pillow-fort", "x/advert-slotted")


def test_vocabulary_on_hosts_of_words_plurals_and_compounds(spark):
    urls = [f"http://{x}.fr/" if "/" not in x else f"http://{x}" for x in (*BAD, *CLEAN)]
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(pages_of(spark, urls)).collect()}
    assert [got[i] for i in range(len(urls))] == ["block"] * len(BAD) + ["allow"] * len(CLEAN)
