"""WARC records: reading and writing files, and resolution of not-modified revisits.

A revisit record of the server-not-modified profile holds a 304 answer without a body. It is joined
as of its time to the latest strictly earlier full response of the same canonical url. Its validators
are checked against that response: entity tags by weak comparison where both have one, else
Last-Modified where both have one, else the payload digest. Where they agree, the 304's permitted
headers replace the stored ones.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ranged, read

#: Headers that a 304 may update (RFC 9110, 15.4.5, and Last-Modified, its other validator).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"(utm_[^=]*|ref|fbclid|gclid)(=.*)?"

HEADERS = "array<struct<name:string,value:string>>"
RECORDS = f"record_id string, kind string, url string, date string, digest string, profile string, status int, headers {HEADERS}, payload binary"
#: How the profile of a revisit that holds a 304 answer ends.
NOT_MODIFIED = "server-not-modified"


def canonical_url(url: Column) -> Column:
    """host/path?parameters: scheme, user, default port, leading www., fragment, tracking
    parameters and trailing slashes removed, host lower-cased, parameters sorted. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@|:(80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.split(F.regexp_extract(bare, r"\?([\s\S]*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))), "&")
    return F.concat(F.regexp_replace(host, r"^www[0-9]*\.", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, its name in any case; null where there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """stored, with every permitted header of fresh in place of stored ones of its name; by name."""
    new = F.filter(F.coalesce(fresh, F.array().cast(HEADERS)), lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(new, lambda h: F.lower(h["name"]))
    old = F.filter(F.coalesce(stored, F.array().cast(HEADERS)), lambda h: ~F.array_contains(names, F.coalesce(F.lower(h["name"]), F.lit(""))))
    return F.array_sort(F.concat(old, new))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """For each revisit: record_id, url, canonical_url, ts, response_id, outcome and headers.

    records: record_id, url, ts (any orderable type), kind ('response' or 'revisit'; rows of other
    kinds take no part), headers and digest, and status and profile if there are such columns, as
    read_warc() has them. A response of a status other than 200 to 299, or of 206, isn't full and takes
    no part, nor does a revisit of another profile than not-modified; a null status or profile is taken
    for a full response and for not-modified. outcome is 'resolved', 'mismatch' (the latest earlier
    response has other validators), 'unverified' (nothing to compare) or 'orphan' (no earlier
    response, or the revisit's url or ts is null). headers are merged where resolved, else the
    revisit's own. Among responses of one url and time the greatest record_id counts as latest (null
    least); a response of the revisit's own time isn't earlier. Repeated revisits are each resolved.

    The as-of join sorts all records by (canonical url, ts) into ranges. Within a range a window
    carries the last response on; a range that begins inside a url gets it from the last earlier
    range with one. So a hot url spreads over many tasks.
    """
    full, unmodified = F.lit(True), F.lit(True)
    if "status" in records.columns:
        full = F.coalesce(F.col("status").between(200, 299) & (F.col("status") != 206), full)
    if "profile" in records.columns:
        unmodified = F.coalesce(F.col("profile").endswith(NOT_MODIFIED), unmodified)
    part = ((F.col("kind") == "response") & full) | ((F.col("kind") == "revisit") & unmodified)
    kinds = records.where(part).select("record_id", "url", "ts", "kind", "headers", "digest")
    keyed = kinds.withColumn("canonical_url", canonical_url(F.col("url")))
    alone = keyed.where((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("ts").isNull()))
    timed = keyed.where(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    order = [F.col("ts"), F.when(F.col("kind") == "revisit", 0).otherwise(1), F.col("record_id")]
    rows = ranged(timed, [F.col("canonical_url"), *order])
    found = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers", "digest"))
    within = Window.partitionBy("part", "canonical_url").orderBy(*order)
    local = rows.withColumn("response", F.last(found, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    revisits = local.where(F.col("kind") == "revisit")
    latest = rows.where(F.col("kind") == "response").groupBy("part", "canonical_url").agg(F.max_by(F.struct("ts", "record_id", "headers", "digest"), F.struct("ts", "record_id")).alias("response"))
    waiting = revisits.where(F.col("response").isNull()).select("part", "canonical_url").distinct()
    ends = latest.unionByName(waiting.withColumn("response", F.lit(None).cast(latest.schema["response"].dataType)))
    earlier = Window.partitionBy("canonical_url").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("before", F.last("response", ignorenulls=True).over(earlier)).where(F.col("before").isNotNull()).groupBy("part", "canonical_url").agg(F.first("before").alias("before"))
    joined = revisits.join(carried, ["part", "canonical_url"], "left").withColumn("response", F.coalesce("response", "before"))
    columns = ["record_id", "url", "canonical_url", "ts", "headers", "digest", "response"]
    return _judged(joined.select(*columns).unionByName(alone.withColumn("response", F.lit(None).cast(joined.schema["response"].dataType)).select(*columns)))


def _judged(revisits: DataFrame) -> DataFrame:
    stored, fresh = F.col("response.headers"), F.col("headers")
    etags = [F.regexp_replace(header(h, "etag"), "^W/", "") for h in (stored, fresh)]
    dates = [header(h, "last-modified") for h in (stored, fresh)]
    digests = [F.col("response.digest"), F.col("digest")]
    same = F.lit(None).cast("boolean")
    for a, b in (digests, dates, etags):
        same = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(same)
    outcome = F.when(F.col("response").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    merged = F.when(F.col("outcome") == "resolved", merged_headers(stored, fresh)).otherwise(fresh)
    return revisits.withColumn("outcome", outcome).select("record_id", "url", "canonical_url", "ts", F.col("response.record_id").alias("response_id"), "outcome", merged.alias("headers"))


# Files


class _Unpacked(io.RawIOBase):
    """A file's content: as it is, or its gzip members unpacked up to damage or what is no member."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.plain = data, 0, None, not data.startswith(b"\x1f\x8b")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        out = b""
        while not out and self.at < len(self.data):
            if self.plain:
                out = self.data[self.at : self.at + len(buffer)]
                self.at += len(out)
                continue
            if self.member is None and not self.data.startswith(b"\x1f\x8b", self.at):
                break
            self.member = self.member or zlib.decompressobj(31)
            piece = self.data[self.at : self.at + 4096]
            try:
                out = self.member.decompress(piece, len(buffer))
            except zlib.error:
                break
            self.at += len(piece) - len(self.member.unused_data if self.member.eof else self.member.unconsumed_tail)
            if self.member.eof:
                self.member = None
        if not out and self.member is not None and self.at == len(self.data):
            out = self.member.decompress(b"", len(buffer))  # what a member that is cut off still holds
        buffer[: len(out)] = out
        return len(out)

    def resume(self) -> bytes:
        """Goes to the next gzip member; the bytes passed over."""
        start, self.member = self.at, None
        found = self.data.find(b"\x1f\x8b\x08", start + 1)
        self.at = len(self.data) if found < 0 else found
        return self.data[start : self.at]


def records_and_gaps(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped (whole or member by member) or plain, and what is none.

    After a record that is cut off or malformed reading starts again at the next line that begins with
    WARC/, after a damaged gzip member at the next one. What is passed over is a row of kind 'skipped'
    with its bytes as payload, unpacked where they could be.
    """
    raw = _Unpacked(data)
    source = io.BufferedReader(raw)
    while raw.at < len(data):
        yield from _stretch(source)
        if raw.at < len(data) and (lost := raw.resume()).strip(b"\0"):
            yield _gap([lost])


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of records_and_gaps()."""
    return (r for r in records_and_gaps(data) if r["kind"] != "skipped")


def _gap(lost: list[bytes]) -> dict:
    return {"record_id": None, "kind": "skipped", "url": None, "date": None, "digest": None, "profile": None, "status": None, "headers": [], "payload": b"".join(lost)}


def _stretch(source) -> Iterator[dict]:
    lost: list[bytes] = []
    line = source.readline()
    while line:
        if not line.startswith(b"WARC/"):
            if lost or line.strip():
                lost.append(line)
            line = source.readline()
            continue
        head = [line]
        while (line := source.readline()).strip() and not line.startswith(b"WARC/"):
            head.append(line)
        if line.startswith(b"WARC/"):
            lost += head
            continue
        head.append(line)
        fields = {n.lower(): v for n, v in _fields(io.BytesIO(b"".join(head[1:])))}
        length = fields.get("content-length", "0")
        if not line or not re.fullmatch("[0-9]{1,18}", length):
            lost += head
            line = source.readline()
            continue
        pieces, left = [], int(length)
        while left and (piece := source.read(min(left, 1 << 20))):
            pieces.append(piece)
            left -= len(piece)
        block = b"".join(pieces)
        if left:  # the length may be wrong, and records begin in what was read
            inside = re.search(rb"(?m)^WARC/", block)
            lost += [*head, block[: inside.start()] if inside else block]
            source = io.BytesIO(block[inside.start() :] if inside else b"")
        else:
            if lost:
                yield _gap(lost)
                lost = []
            yield _record(fields, block)
        line = source.readline()
    if lost:
        yield _gap(lost)


def _fields(source) -> Iterator[tuple[str, str]]:
    while (line := source.readline()).strip():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            yield name.strip(), value.strip()


def _record(fields: dict[str, str], block: bytes) -> dict:
    kind, status, headers, payload = fields.get("warc-type"), None, [], block
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        source = io.BytesIO(block)
        first = source.readline().split()
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        headers = [{"name": n, "value": v} for n, v in _fields(source)]
        payload = source.read()
    return {"record_id": fields.get("warc-record-id"), "kind": kind, "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": fields.get("warc-payload-digest"), "profile": fields.get("warc-profile"), "status": status, "headers": headers, "payload": payload}


def format_record(record: dict) -> bytes:
    """One record as a gzip member, for files that parse_warc() reads back."""
    block = record.get("payload") or b""
    if record.get("status") is not None:
        lines = [f"HTTP/1.1 {record['status']}", *(f"{h['name']}: {h['value']}" for h in record.get("headers") or ())]
        block = ("\r\n".join(lines) + "\r\n\r\n").encode() + block
    fields = {"WARC-Type": record.get("kind"), "WARC-Record-ID": record.get("record_id"), "WARC-Target-URI": record.get("url"), "WARC-Date": record.get("date"), "WARC-Payload-Digest": record.get("digest"), "WARC-Profile": record.get("profile"), "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under path, as resolve_revisits() takes them, and rows of kind
    'skipped' of what is none. ts is the date as a timestamp, null where it isn't one. A task holds one
    compressed file at a time."""
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                for record in records_and_gaps(data.as_py()):
                    held.append(record)
                    size += len(record["payload"])
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORDS)
    return records.withColumn("ts", F.try_to_timestamp("date"))


# The production query: pages as a crawl


#: Times between a page's records in the production query.
STEP = 5_000


def page_records(pages: DataFrame, step: int = STEP) -> DataFrame:
    """Four records for each page: a full response at time page_id, a 304 with its entity tag a step
    later, a response of other content and tag after two steps, and after three once more a 304 with
    the first tag, from a client that missed the change. Other pages of a canonical url come between.

    A null page_id gives records without a time, a null html ones without tags; repeated rows give
    repeated records.
    """
    tags = [F.concat(F.lit('"'), F.md5(html), F.lit('"')) for html in (F.col("html"), F.concat("html", F.lit(".")))]
    ts = [F.col("page_id") + i * step for i in range(4)]

    def headers(**values: Column) -> Column:
        pairs = [F.struct(F.lit(k.replace("_", "-")).alias("name"), v.cast("string").alias("value")) for k, v in values.items()]
        return F.filter(F.array(*pairs), lambda h: h["value"].isNotNull())

    def full(i: int, size: Column, tag: str) -> Column:
        return headers(content_type=F.lit("text/html"), content_length=size, date=ts[i], etag=F.col(tag), cache_control=F.lit("max-age=60"))

    def bare(i: int) -> Column:
        return headers(content_type=F.lit("text/plain"), date=ts[i], etag=F.col("tag0"), cache_control=F.lit("no-cache"))

    tagged = pages.select("page_id", "url", F.octet_length("html").alias("size"), tags[0].alias("tag0"), tags[1].alias("tag1"))
    parts = [("response", full(0, F.col("size"), "tag0")), ("revisit", bare(1)), ("response", full(2, F.col("size") + 1, "tag1")), ("revisit", bare(3))]
    records = F.array(*(F.struct(ts[i].alias("ts"), F.lit(kind).alias("kind"), h.alias("headers")) for i, (kind, h) in enumerate(parts)))
    return tagged.select(F.col("page_id").alias("record_id"), "url", F.inline(records)).withColumn("digest", F.lit(None).cast("string"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, visit (its time), canonical_url, response_page_id, outcome and headers of each revisit.

    Where two responses of a canonical url have one time, that of the greater page_id is the latest.
    """
    done = resolve_revisits(page_records(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    joined = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return done.select(F.col("record_id").alias("page_id"), F.col("ts").alias("visit"), "canonical_url", F.col("response_id").alias("response_page_id"), "outcome", joined.alias("headers"))


OP8_SQL = f"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), keyed AS (
  SELECT page_id, octet_length(encode(html)) AS size, '"' || md5(html) || '"' AS etag, '"' || md5(html || '.') || '"' AS changed,
         regexp_replace(lower(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@|:(80|443)$', '', 'g')), '^www[0-9]*\\.', '')
         || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1, 's'), '&'),
           lambda p: p <> '' AND NOT regexp_full_match(p, '{TRACKING}'))), '&') AS params
  FROM bare
), crawl AS (
  SELECT page_id, size, etag, changed, page || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS canonical_url FROM keyed
), responses AS (
  SELECT canonical_url, page_id AS ts, page_id, size, etag FROM crawl
  UNION ALL SELECT canonical_url, page_id + {2 * STEP}, page_id, size + 1, changed FROM crawl
), latest AS (
  SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY canonical_url, ts ORDER BY page_id DESC) = 1
), revisits AS (
  SELECT page_id, canonical_url, etag, page_id + {STEP} AS ts FROM crawl
  UNION ALL SELECT page_id, canonical_url, etag, page_id + {3 * STEP} FROM crawl
), answered AS (
  SELECT r.*, s.page_id AS response_page_id, s.etag AS stored, s.size
  FROM revisits r ASOF LEFT JOIN latest s ON r.canonical_url = s.canonical_url AND r.ts > s.ts
), judged AS (
  SELECT *, CASE WHEN response_page_id IS NULL THEN 'orphan' WHEN etag = stored THEN 'resolved'
            WHEN etag <> stored THEN 'mismatch' ELSE 'unverified' END AS outcome
  FROM answered
)
SELECT page_id, ts AS visit, canonical_url, response_page_id, outcome,
       CASE WHEN outcome = 'resolved'
            THEN 'cache-control: no-cache' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
                 || 'date: ' || ts || chr(10) || 'etag: ' || etag
            ELSE 'content-type: text/plain' || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || etag, '')
                 || chr(10) || 'cache-control: no-cache' END AS headers
FROM judged
"""

QUERIES = {"op8_warc_revisits": op8_warc_revisits}
ORACLES = {"op8_warc_revisits": OP8_SQL}
