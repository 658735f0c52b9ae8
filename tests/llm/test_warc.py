import pytest
from helpers import rows_of, saved, sql_rows
from pyspark.sql import functions as F

from chronoloom.llm import warc

PAGES = "page_id long, url string, html string"
REC = f"record_id long, url string, ts long, kind string, headers {warc.HEADERS}, digest string"


def test_same_rows_as_sql(spark, tmp_path, sf_dir):
    assert rows_of(warc.op8_warc_revisits(spark, sf_dir)) == sql_rows(warc.OP8_SQL, sf_dir)
    urls = ["http://a.b/c", "https://www.A.b/c/#x", "http://a.b:80/c?utm_source=q", "http://a.b/c?y=2&x=1", "http://a.b/c?x=1&ref=r&y=2", "a.b/c", "", "http://u@a.b/c//"]
    rows = [(i, urls[i % 8], None if i % 5 == 4 else f"html {i % 3}") for i in range(90)] + [(i + 9000, urls[0], "html 0") for i in range(30)]
    d = saved(spark, tmp_path, pages=spark.createDataFrame(rows, PAGES))
    assert rows_of(warc.op8_warc_revisits(spark, d)) == sql_rows(warc.OP8_SQL, d)


@pytest.mark.parametrize(
    ("url", "canonical"),
    [("HTTP://WWW.Ex.com:80/A/b/?utm_source=x&b=2&a=1#f", "ex.com/A/b?a=1&b=2"), ("https://ex.com", "ex.com"), ("ex.com/?ref=1", "ex.com"), ("http://ex.com:8080/", "ex.com:8080"), (None, None), ("", "")],
)
def test_canonical_urls(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == canonical


def resolved(spark, *rows):
    got = warc.resolve_revisits(spark.createDataFrame(list(rows), REC)).collect()
    return {r["record_id"]: (r["response_id"], r["outcome"], [tuple(h) for h in r["headers"] or ()]) for r in got}


def test_latest_earlier_response_and_validators(spark):
    tag = [("ETag", "W/\"1\""), ("Content-Length", "9"), ("Cache-Control", "old"), ("Content-Type", "text/html")]
    got = resolved(
        spark,
        (1, "http://a/x", 10, "response", tag, None),
        (2, "http://a/x", 20, "response", [("etag", '"2"')], None),
        (11, "http://a/x#f", 15, "revisit", [("etag", '"1"'), ("cache-control", "new"), ("content-type", "no")], None),
        (12, "http://a/x", 20, "revisit", [("etag", '"1"')], None),
        (13, "http://a/x", 21, "revisit", [("etag", '"1"')], None),
        (14, "http://a/x", 22, "revisit", [], None),
        (15, "http://a/x", 5, "revisit", [("etag", '"1"')], None),
        (16, None, 50, "revisit", None, None),
        (17, "http://a/x", None, "revisit", None, None),
        (18, "http://b", 30, "request", None, None),
    )
    assert got[11] == (1, "resolved", [("Content-Length", "9"), ("Content-Type", "text/html"), ("cache-control", "new"), ("etag", '"1"')])
    assert got[12][:2] == (1, "resolved") and got[13][:2] == (2, "mismatch") and got[14][:2] == (2, "unverified")
    assert [got[i][:2] for i in (15, 16, 17)] == [(None, "orphan")] * 3 and 18 not in got


def test_dates_and_digests(spark):
    lm = [("Last-Modified", "d1")]
    got = resolved(spark, (1, "a", 1, "response", lm, "x"), (2, "a", 2, "revisit", lm, "y"), (3, "a", 3, "revisit", [("last-modified", "d2")], "x"), (4, "a", 4, "revisit", [], "x"), (5, "a", 5, "revisit", [], "z"))
    assert [got[i][1] for i in (2, 3, 4, 5)] == ["resolved", "mismatch", "resolved", "mismatch"]


def test_hot_url_across_ranges(spark):
    """Most of the records are of one url, with long runs without a response."""
    rows = [(i, "http://hot/", i, "response" if i % 400 == 0 else "revisit", [("etag", str(i // 400))], None) for i in range(2000)]
    rows += [(5000 + i, f"http://h{i}/", i, "revisit", None, None) for i in range(50)]
    got = resolved(spark, *rows)
    assert all(got[i][:2] == (i // 400 * 400, "resolved") for i in range(2000) if i % 400) and all(got[5000 + i][1] == "orphan" for i in range(50))


def test_ties_repeats_and_empty(spark):
    got = warc.resolve_revisits(spark.createDataFrame([(1, "a", 1, "response", None, None), (2, "a", 1, "response", None, None), (None, "a", 1, "response", None, None), (9, "a", 2, "revisit", None, None), (9, "a", 2, "revisit", None, None)], REC)).collect()
    assert [(r["record_id"], r["response_id"]) for r in got] == [(9, 2)] * 2
    assert warc.resolve_revisits(spark.createDataFrame([], REC)).collect() == []


RECORDS = [
    {"record_id": "<a>", "kind": "response", "url": "http://a/", "date": "2024-01-01T00:00:00Z", "digest": "sha1:A", "profile": None, "status": 200, "headers": [{"name": "ETag", "value": '"1"'}], "payload": b"<html>\r\n\r\nx"},
    {"record_id": "<b>", "kind": "revisit", "url": "http://a/", "date": "2024-01-02T00:00:00Z", "digest": "sha1:A", "profile": "http://netpreserve.org/warc/1.1/revisit/server-not-modified", "status": 304, "headers": [], "payload": b""},
    {"record_id": "<c>", "kind": "warcinfo", "url": None, "date": None, "digest": None, "profile": None, "status": None, "headers": [], "payload": b"software: x"},
]


def test_file_roundtrip(spark, tmp_path):
    data = b"".join(map(warc.format_record, RECORDS))
    assert list(warc.parse_warc(data)) == RECORDS
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [r["record_id"] for r in got] == ["<a>", "<b>", "<c>"] and bytes(got[0]["payload"]) == RECORDS[0]["payload"] and got[0]["headers"][0]["value"] == '"1"'


def test_files_resolve(spark, tmp_path):
    """What read_warc() gives is what resolve_revisits() takes; a part or an error isn't a full response."""
    day = "2024-01-02T%02d:00:00Z"
    part, gone = ({**RECORDS[0], "record_id": i, "date": day % h, "status": status, "digest": "sha1:B"} for i, h, status in (("<p>", 1, 206), ("<g>", 2, 404)))
    late = {**RECORDS[1], "record_id": "<l>", "date": day % 3, "headers": [{"name": "Expires", "value": "0"}]}
    same = {**RECORDS[1], "record_id": "<s>", "date": day % 4, "profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    timeless = {**RECORDS[1], "record_id": "<t>", "date": "yesterday"}
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(warc.format_record, [*RECORDS, part, gone, late, same, timeless])))
    got = {r["record_id"]: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()}
    assert {i: (r["response_id"], r["outcome"]) for i, r in got.items()} == {"<b>": ("<a>", "resolved"), "<l>": ("<a>", "resolved"), "<t>": (None, "orphan")}
    assert [tuple(h) for h in got["<l>"]["headers"]] == [("ETag", '"1"'), ("Expires", "0")]


def test_query_meets_every_outcome_and_empty_tables(spark, tmp_path):
    """Pages of one canonical url come between a page's response and its revisits."""
    urls = ["http://a.b/c", "http://A.b/c#x", "http://a.b/d", None]
    rows = [(i * 1000, urls[i % 4], f"html {i // 8 % 2}" if i % 7 else None) for i in range(40)]
    d = saved(spark, tmp_path, pages=spark.createDataFrame(rows, PAGES))
    got = rows_of(warc.op8_warc_revisits(spark, d))
    assert got == sql_rows(warc.OP8_SQL, d) and len(got) == 80
    out = warc.op8_warc_revisits(spark, d).collect()
    assert {r["outcome"] for r in out} == {"resolved", "mismatch", "unverified", "orphan"}
    assert any(r["outcome"] == "resolved" and r["response_page_id"] != r["page_id"] for r in out)
    d = saved(spark, tmp_path / "none", pages=spark.createDataFrame([], PAGES))
    assert warc.op8_warc_revisits(spark, d).collect() == [] and sql_rows(warc.OP8_SQL, d) == []


@pytest.mark.parametrize("cut", [1, 30, 200])
def test_files_cut_off(cut):
    data = b"".join(map(warc.format_record, RECORDS))
    # The last byte is of the last member's check sum, after its record.
    assert len(list(warc.parse_warc(data[:-cut]))) == {1: 3, 30: 2, 200: 1}[cut]
    assert list(warc.parse_warc(b"junk")) == []


def test_records_after_damage_are_read(spark, tmp_path):
    import gzip

    a, b, c = map(warc.format_record, RECORDS)
    plain = [gzip.decompress(x) for x in (a, b, c)]
    damaged = b[:20] + bytes(x ^ 255 for x in b[20:60]) + b[60:]
    no_length = plain[1].replace(b"Content-Length: ", b"Content-Length: x")
    too_long = plain[1].replace(b"Content-Length: ", b"Content-Length: 9999")
    files = {
        "member": a + damaged + c,
        "junk": a + b"no member" + c,
        "header": plain[0] + no_length + plain[2],
        "length": plain[0] + too_long + plain[2],
        "line": plain[0] + b"WURC/1.1\r\n" + plain[1][10:] + plain[2],
        "packed": gzip.compress(plain[0] + no_length + plain[2]),
    }
    for name, data in files.items():
        assert list(warc.parse_warc(data)) == [RECORDS[0], RECORDS[2]], name
        assert sum(len(r["payload"]) for r in warc.records_and_gaps(data) if r["kind"] == "skipped") > 8, name
        (tmp_path / name).write_bytes(data)
    kinds = [r["kind"] for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert kinds.count("response") == kinds.count("warcinfo") == 6 and kinds.count("skipped") >= 6
    assert list(warc.parse_warc(plain[0] + plain[1][:-8])) == [RECORDS[0]] and len(list(warc.records_and_gaps(plain[0] + plain[1][:-8]))) == 2
    whole = [{**RECORDS[0], "payload": b"x\n" * 3_000_000}]
    assert list(warc.records_and_gaps(warc.format_record(whole[0]) + a)) == [*whole, RECORDS[0]]
