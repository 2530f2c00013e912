"""WARC derivatives: metadata and plain-text conversion records from responses.

A record is a row: ``record_id, record_type, target_uri, date, refers_to,
content_type, headers, block, block_digest, payload_digest``.  ``headers`` holds
the source's HTTP headers, in order.  Each response gives one ``metadata`` and one
``conversion`` record; both name it in ``refers_to`` and carry its headers and the
digest of its payload.  Identifiers are derived from content, so a task that runs
again after a lost executor writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tuned

RECORD = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, content_type string, "
    "headers array<struct<name:string,value:string>>, block binary, block_digest string, payload_digest string"
)
#: The date of captures whose table has none.
NO_DATE = "1970-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<noscript\b.*?(?:</noscript\s*>|\Z)|<template\b.*?(?:</template\s*>|\Z)", re.I | re.S)
_TAIL = r"""(?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+(?:>|\Z)"""
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b" + _TAIL, re.I)
_TAG = re.compile(r"</?[a-z]" + _TAIL + r"|<[!?][^>]*(?:>|\Z)", re.I)
_BLANKS = re.compile("[ \t\r\f\v ]+")
_EDGES = re.compile(" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z0-9-]+)""", re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(kind: str, *parts: str) -> str:
    """A name-based UUID: the same record always has the same identifier."""
    x = hashlib.md5("\n".join((kind, *parts)).encode()).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-3{x[13:16]}-8{x[17:20]}-{x[20:]}>"


def plain_text(markup: str) -> str:
    """Visible text, a line for each block; entities decoded after tags are gone."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", markup))))
    return _EDGES.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def _one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def fields_of(markup: str, headers: list[dict]) -> str:
    """The body of a metadata record: the source's content type, then what the markup declares."""
    visible = _HIDDEN.sub("", markup)
    out = [f"content-type: {h['value']}" for h in headers or [] if (h["name"] or "").lower() == "content-type"]
    out += [f"html-lang: {x.lower()}" for x in _LANG.findall(visible)[:1]]
    out += [f"title: {_one_line(x)}" for x in _TITLE.findall(visible)[:1]]
    out += [f"outlink: {_one_line(x)}" for x in _LINK.findall(visible)]
    return "".join(f"{x}\r\n" for x in out)


def page_responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Response records for a table of pages; the block is the payload alone.

    A null url counts as empty, null markup as an empty page.  Repeated captures
    (same url and payload) get the same identifier.
    """
    url, body = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    date = F.coalesce(F.col(date_col).cast("string"), F.lit(NO_DATE)) if date_col else F.lit(NO_DATE)
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    headers = F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.octet_length(body)))
    x = F.md5(F.concat(F.lit("response\n"), url, F.lit("\n"), F.sha1(body)).cast("binary"))
    name = F.concat(F.lit("<urn:uuid:"), F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-3"), F.substring(x, 14, 3), F.lit("-8"), F.substring(x, 18, 3), F.lit("-"), F.substring(x, 21, 12), F.lit(">"))
    return pages.select(name.alias("record_id"), F.lit("response").alias("record_type"), url.alias("target_uri"), date.alias("date"), F.lit(None).cast("string").alias("refers_to"), F.lit("text/html").alias("content_type"), headers.alias("headers"), body.cast("binary").alias("block"))


def _charset(headers: list[dict]) -> str:
    for h in headers or []:
        if (h["name"] or "").lower() == "content-type" and (m := re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", h["value"] or "", re.I)):
            try:
                "".encode(m[1])
                return m[1]
            except LookupError:
                pass
    return "utf-8"


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response, in ``RECORD``'s columns.

    Rows of other record types are passed over.  An empty payload gives both
    records too, the conversion's block being empty.  Undecodable bytes become
    U+FFFD; null headers count as none.  No shuffle: a map over the rows.
    """
    tuned(responses.sparkSession)
    rows = responses.where(F.col("record_type") == "response").select("record_id", "target_uri", "date", "headers", F.coalesce(F.col("block").cast("binary"), F.lit(b"")).alias("block"))
    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for source, uri, date, headers, block in zip(*(c.to_pylist() for c in batch.columns)):
                markup = block.decode(_charset(headers), "replace")
                payload = digest(block)
                for kind, content, text in (("metadata", "application/warc-fields", fields_of(markup, headers)), ("conversion", "text/plain; charset=utf-8", plain_text(markup))):
                    body = text.encode("utf-8", "replace")
                    for column, value in zip(out, (identifier(kind, source or "", payload), kind, uri, date, source, content, headers, body, digest(body), payload)):
                        column.append(value)
            kinds = [pa.string()] * 6 + [pair, pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    return rows.mapInArrow(run, RECORD)


def serialise(record: dict) -> bytes:
    """One record in WARC 1.1 syntax, as a gzip member of its own."""
    block = record["block"] or b""
    head = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"])]
    head += [("WARC-Block-Digest", record["block_digest"]), ("WARC-Source-Payload-Digest", record["payload_digest"]), ("Content-Type", record["content_type"])]
    head += [(f"WARC-Source-Header-{h['name']}", h["value"]) for h in record["headers"] or []]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", mtime=0)


def with_bytes(records: DataFrame) -> DataFrame:
    """``records`` with ``warc binary``: members that, joined in any order, form a file."""
    tuned(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([serialise(x) for x in b.to_pylist()], pa.binary())], names=[*b.schema.names, "warc"])

    return records.mapInArrow(run, T.StructType([*records.schema.fields, T.StructField("warc", T.BinaryType())]))


def parse(data: bytes) -> Iterator[dict]:
    """The records of one file's bytes, compressed or not; HTTP headers are split from response blocks."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", start)) >= 0:
        lines = [x.partition(":") for x in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]]
        head = [(k.strip(), v.strip()) for k, _, v in lines]
        get = {k.lower(): v for k, v in head}
        size = int(get.get("content-length", "0"))
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        headers = [{"name": k[19:], "value": v} for k, v in head if k.lower().startswith("warc-source-header-")]
        if get.get("warc-type") == "response" and block.startswith(b"HTTP/"):
            top, _, block = block.partition(b"\r\n\r\n")
            headers = [{"name": k.strip(), "value": v.strip()} for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])]
        yield {
            "record_id": get.get("warc-record-id"), "record_type": get.get("warc-type"), "target_uri": get.get("warc-target-uri"), "date": get.get("warc-date"), "refers_to": get.get("warc-refers-to"),
            "content_type": get.get("content-type"), "headers": headers, "block": block, "block_digest": get.get("warc-block-digest"), "payload_digest": get.get("warc-source-payload-digest") or get.get("warc-payload-digest"),
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (each read whole by one task) in ``RECORD``'s columns."""
    files = tuned(spark).read.format("binaryFile").load(path).select("content")
    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 6 + [pair, pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                held: list[dict] = []
                for r in parse(data):
                    held.append(r)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds)], names=names)

    return files.mapInArrow(run, RECORD)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Both derived records of every page, with text blocks and one line of source headers."""
    records = derive(page_responses(pages))
    return records.select(
        "record_id", "record_type", "refers_to", "target_uri", "date", "content_type",
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("source_headers"),
        "payload_digest", "block_digest", F.octet_length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("block"),
    )


def _sql() -> str:
    hidden = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)"
    rest = r"""(?:[^>"'']|"[^"]*(?:"|\z)|''[^'']*(?:''|\z))*(?:>|\z)"""
    names = _BREAK.pattern[4:].split(r")\b")[0].removeprefix("(?:").removeprefix("?:")
    digest_of = lambda x: (  # noqa: E731  base 32 of the 160 bits, four digits for every five hexadecimal ones
        f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1({x}), 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')"
    )
    name_of = lambda x: f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-3' || substr({x}, 14, 3) || '-8' || substr({x}, 18, 3) || '-' || substr({x}, 21, 12) || '>'"
    decode = lambda x: f"regexp_replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
    line = lambda x: f"trim(regexp_replace({decode(x)}, '\\s+', ' ', 'g'))"
    return f"""
WITH p AS (SELECT coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, {digest_of('h')} AS payload_digest, md5('response' || chr(10) || u || chr(10) || sha1(h)) AS m, regexp_replace(h, '{hidden}', '', 'g') AS v FROM p),
r AS (SELECT *, {name_of('m')} AS refers_to FROM q),
s AS (
  SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type,
    trim(regexp_replace(regexp_replace({decode(f"regexp_replace(regexp_replace(v, '(?i)</?(?:{names})" + chr(92) + f"b{rest}', chr(10), 'g'), '(?i)</?[a-z]{rest}|<[!?][^>]*(?:>|" + chr(92) + "z)', '', 'g')")}, '[ \\t\\r\\f\\v\\x{{00a0}}]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS block FROM r
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields',
    'content-type: text/html; charset=utf-8' || chr(13) || chr(10)
    || CASE WHEN regexp_matches(v, '(?i)<html\\b[^>]*?\\blang\\s*=\\s*["'']?([a-z0-9-]+)') THEN 'html-lang: ' || lower(regexp_extract(v, '(?i)<html\\b[^>]*?\\blang\\s*=\\s*["'']?([a-z0-9-]+)', 1)) || chr(13) || chr(10) ELSE '' END
    || CASE WHEN regexp_matches(v, '(?is)<title\\b[^>]*>(.*?)</title\\s*>') THEN 'title: ' || {line("regexp_extract(v, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title" + chr(92) + "s*>', 1)")} || chr(13) || chr(10) ELSE '' END
    || array_to_string(list_transform(regexp_extract_all(v, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: 'outlink: ' || {line('x')} || chr(13) || chr(10)), '') FROM r),
t AS (SELECT *, md5(record_type || chr(10) || refers_to || chr(10) || payload_digest) AS n FROM s)
SELECT {name_of('n')} AS record_id, record_type, refers_to, u AS target_uri, '{NO_DATE}' AS date, content_type,
  'Content-Type: text/html; charset=utf-8' || chr(10) || 'Content-Length: ' || strlen(h) AS source_headers,
  payload_digest, {digest_of('block')} AS block_digest, strlen(block)::BIGINT AS content_length, block
FROM t"""


#: The entities that the SQL knows are those of the synthetic pages; the operator knows all.
PAGE_DERIVATIVES_SQL = _sql()
