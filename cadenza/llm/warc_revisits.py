"""WARC records, and the resolution of not-modified revisits.

``records`` parses WARC files (plain or gzip members) into rows. ``resolved``
joins each server-not-modified revisit as of its date to the latest earlier full response of the same
canonical URL, checks the validators (ETag if both have one, else Last-Modified), and merges the
headers that a 304 response may update. Only record ids, dates and headers are
joined, never payloads.

The as-of join sorts in two steps, so that a URL with very many captures is split by
time: within (URL, hour) by a window, and over the last responses of each hour by a second, small one.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import exchange as X
from cadenza.llm.kernels import slices

DATES = 10_000_000_000
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
# Fixed values of RFC 9111, section 3.2, and RFC 9110, section 7.6.1: headers that a 304 response must not change.
UNTOUCHED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
ROWS = "record_id string, type string, date string, uri string, profile string, status int, headers map<string,string>, payload binary"
ARROW_ROWS = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("profile", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
STATUS = re.compile(rb"HTTP/\d(?:\.\d)?\s+(\d{3})")


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def http(status: str, fields: list[tuple[str, str]], body: bytes = b"") -> bytes:
    return f"HTTP/1.1 {status}\r\n{''.join(f'{k}: {v}\r\n' for k, v in fields)}\r\n".encode() + body


def fields_of(head: bytes) -> dict[str, str]:
    """Names in lower case; continuation lines join, repeated names join with a comma."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def members(data: bytes):
    """The plain bytes of a file of gzip members, as far as they are whole; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            parts.append(d.decompress(data) + d.flush())
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(parts)


def parse(data: bytes):
    """Records of one file; a broken record ends it."""
    data, at = members(data), 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        f = fields_of(data[at:end])
        size = f.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        status, headers, payload = None, {}, block
        if f.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            line, _, rest = head.partition(b"\r\n")
            m = STATUS.match(line)
            status, headers = int(m[1]) if m else None, fields_of(rest)
        yield {"record_id": f.get("warc-record-id"), "type": f.get("warc-type"), "date": f.get("warc-date"), "uri": f.get("warc-target-uri", "").strip("<>") or None, "profile": f.get("warc-profile"), "status": status, "headers": list(headers.items()), "payload": payload}


def records(files: DataFrame, column: str = "content") -> DataFrame:
    """Rows of all records of files of bytes. Null and empty files have none."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                rows = [r for data in part.column(column).to_pylist() if data for r in parse(data)]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_ROWS)

    return files.select(column).mapInArrow(run, ROWS)


def canonical(url):
    """Scheme and www. dropped, host in lower case, default ports, fragments, tracking parameters and a last slash dropped."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.|:80$|:443$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, r"([?&])utm_[A-Za-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/$", ""))


def resolved(rows: DataFrame) -> DataFrame:
    """One row per not-modified revisit: record_id, url (canonical), date, verdict, source_id, source_date, status, headers.

    Verdicts: ``resolved``; ``changed`` (the validators differ); ``unproven`` (no validator in common);
    ``missing`` (no earlier full response). Headers are the stored ones, with those of the revisit that may
    replace them, null unless resolved. A full response has type response and status 200.
    Of responses at one date the greater record id counts; a response at the revisit's own
    date is not earlier. Rows without a URL or a date resolve to ``missing``. Repeated records give repeated rows.
    """
    rows = rows.select("record_id", "type", "profile", "status", canonical(F.col("uri")).alias("url"), F.to_timestamp("date").alias("at"), "date", "headers")
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("at").isNotNull()
    visit = (F.col("type") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    rows = rows.where(full | visit).withColumn("hour", F.floor(F.unix_timestamp("at") / 3600))
    source = F.struct("at", F.col("record_id").alias("source_id"), F.col("date").alias("source_date"), F.col("headers").alias("stored"))
    rows = rows.withColumn("source", F.when(full, source))
    # the last response of each (url, hour), and for each hour with rows the last one of the hours before
    hours = rows.groupBy("url", "hour").agg(F.max_by("source", F.when(full, F.struct("at", "record_id"))).alias("last"))
    before = Window.partitionBy("url").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("url", "hour", F.last("last", ignorenulls=True).over(before).alias("older")).where("older IS NOT NULL")
    # at one instant revisits come first, so that a response then is not earlier
    inside = Window.partitionBy("url", "hour").orderBy("at", F.when(full, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    visits = rows.withColumn("newer", F.last("source", ignorenulls=True).over(inside)).where(visit).drop("source")
    found = visits.join(hours, ["url", "hour"], "left").withColumn("found", F.coalesce("newer", "older"))
    tag, stored_tag = F.col("headers")["etag"], F.col("found.stored")["etag"]
    when, stored_when = F.col("headers")["last-modified"], F.col("found.stored")["last-modified"]
    same = F.when(tag.isNotNull() & stored_tag.isNotNull(), weak(tag) == weak(stored_tag)).when(when.isNotNull() & stored_when.isNotNull(), when == stored_when)
    verdict = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unproven").when(same, "resolved").otherwise("changed")
    may = F.map_filter("headers", lambda k, _: ~k.isin(UNTOUCHED))
    kept = F.map_filter(F.col("found.stored"), lambda k, _: ~F.map_contains_key(may, k))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, may))))
    ok = F.col("verdict") == "resolved"
    return found.withColumn("verdict", verdict).select("record_id", "url", "date", "verdict", F.col("found.source_id").alias("source_id"), F.col("found.source_date").alias("source_date"), F.when(ok, 200).alias("status"), F.when(ok, merged).alias("headers"))


def weak(tag):
    return F.regexp_replace(tag, r"^W/", "")


def captures(pages: DataFrame) -> DataFrame:
    """WARC files, one for each page: its response, and a revisit of its URL up to 200 seconds before or 1800 after. Dates come again every DATES ids."""

    def run(batches):
        start = datetime.datetime(2024, 1, 1)
        for batch in batches:
            for part in slices(batch, "html"):
                files = []
                for key, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    key, url, body = key or 0, (url or "").replace("\r", "").replace("\n", ""), (html or "").encode()
                    first = start + datetime.timedelta(seconds=2 * int(math.copysign(abs(key) % DATES, key)))
                    again = first + datetime.timedelta(seconds=2 * (int(hashlib.md5(url.encode()).hexdigest()[:4], 16) % 1000) - 199)
                    tag = f'"{hashlib.md5(body).hexdigest()}"'
                    for kind, date, block in (
                        ("response", first, http("200 OK", [("Content-Type", "text/html"), ("Content-Length", str(len(body))), ("ETag", tag), ("Cache-Control", "max-age=60"), ("Server", "a")], body)),
                        ("revisit", again, http("304 Not Modified", [("ETag", "W/" + tag), ("Cache-Control", "max-age=600"), ("Content-Type", "text/plain"), ("Age", "7")])),
                    ):
                        more = [("WARC-Profile", NOT_MODIFIED)] if kind == "revisit" else []
                        files.append(gzip.compress(record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{key}:{kind}>"), ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", url), ("Content-Type", "application/http"), *more], block), 1, mtime=0))
                yield pa.RecordBatch.from_arrays([pa.array([a + b for a, b in zip(files[::2], files[1::2], strict=True)], pa.binary())], names=["content"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "content binary")


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    rows = X.written(records(captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("payload"), "records")  # files are parsed once
    out = resolved(rows)
    told = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(":"), e.value)), ";")
    return out.select("record_id", "url", "date", "verdict", "source_id", "source_date", "status", told.alias("headers"))



OP9_SQL = r"""
WITH captured AS (
  SELECT page_id, md5(html) AS tag, TIMESTAMP '2024-01-01' + to_seconds(2 * (page_id % 10000000000)) AS seen, octet_length(encode(html)) AS size,
         2 * (('0x' || substr(md5(url), 1, 4))::INT % 1000) - 199 AS later,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages),
split AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.|:80$|:443$', '', 'g') AS h,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])utm_[A-Za-z]+=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g') AS r
  FROM captured),
named AS (SELECT *, h || regexp_replace(regexp_replace(r, '[?&]+$', ''), '/$', '') AS canon FROM split),
visits AS (SELECT page_id, tag, canon, seen + to_seconds(later) AS seen FROM named),
joined AS (
  SELECT v.page_id, v.tag, v.canon, v.seen, n.page_id AS source, n.tag AS stored, n.seen AS stored_at, n.size,
         row_number() OVER (PARTITION BY v.page_id ORDER BY n.seen DESC NULLS LAST, '<urn:page:' || n.page_id || ':response>' DESC) AS k
  FROM visits v LEFT JOIN named n ON v.canon = n.canon AND n.seen < v.seen)
SELECT '<urn:page:' || page_id || ':revisit>' AS record_id, canon AS url, strftime(seen, '%Y-%m-%dT%H:%M:%SZ') AS date,
       CASE WHEN source IS NULL THEN 'missing' WHEN tag = stored THEN 'resolved' ELSE 'changed' END AS verdict,
       CASE WHEN source IS NOT NULL THEN '<urn:page:' || source || ':response>' END AS source_id,
       strftime(stored_at, '%Y-%m-%dT%H:%M:%SZ') AS source_date,
       CASE WHEN tag = stored THEN 200 END AS status,
       CASE WHEN tag = stored THEN 'age:7;cache-control:max-age=600;content-length:' || size || ';content-type:text/html;etag:W/"' || tag || '";server:a' END AS headers
FROM joined WHERE k = 1
"""
