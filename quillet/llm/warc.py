"""WARC derivatives: metadata and plain-text records from responses (operator 3).

Each response gives two records that refer to it: a ``metadata`` record (JSON of
the HTTP headers, title, language and links) and a ``conversion`` record (plain
text).  Both keep the response's identifier in WARC-Refers-To, its target, date
and HTTP headers, and the digest of its payload; each has an identifier of its
own, made from the response's, so that a rerun gives the same records, and a
digest of its own block.

``read_warc`` reads responses from WARC files, compressed record by record or
not, with their payloads as bytes and the digests that they came with; ``serialized`` gives
the bytes of derived records, ready to be written.

The payload digest is that of the bytes received, without chunking.  For the text, the
body is undone by Transfer-Encoding and Content-Encoding (gzip, deflate) and decoded by the charset of its
byte-order mark, its Content-Type or its first ``meta`` element, else as UTF-8.

A page is read by one scanner in one pass: a tag ends at its first ``>`` and a new
``<`` gives it up, a comment or script that is never closed takes the rest of the
page.  Time is in proportion to the page's length, whatever it holds.

Scale: one map over the responses; no shuffle, memory bounded by an Arrow batch.
Pages become responses with ids from their own id, URL and contents.  Where rows
repeat as a whole (a count of digests tells), the table is written once with a
number for each row, which enters the ids, so that ids stay unique.

Edge cases: a null payload is an empty one and still gives both records; a null
URL or date is left out of the headers; repeated pages give records with ids of
their own; extra columns are ignored; an empty table gives an empty result.  What is
damaged has a ``fault`` and never fails the job: a record cut short keeps what there is, a
gzip member or a length that cannot be read is a row without a payload (``derive`` makes no
records of it), a body that cannot be undone is read as far as it goes.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

RESPONSE = ("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload", "source_payload_digest", "source_block_digest", "fault")
_RESPONSES = (
    "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload binary, source_payload_digest string,"
    " source_block_digest string, fault string"
)
SCHEMA = (
    "page_id long, record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string,"
    " content_length long, block_digest string, payload_digest string, http_headers string, block string,"
    " source_payload_digest string, source_block_digest string, fault string"
)
_TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|[!?][^<>]*+>)")
#: Elements whose contents are no text, and how their ends are found.
_RAW = {name: re.compile(rf"</{name}(?![\w-])", re.I) for name in ("script", "style", "noscript", "template", "title")}
_BREAKS = frozenset(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section header footer nav aside pre blockquote body hr".split()
)
_BLANKS = re.compile(r"[^\S\n]+")
_VALUE = r"\s*+=\s*+[\"']?([^\"'\s>]++)"
_LANG, _HREF = (re.compile(rf"(?<![\w-]){name}{_VALUE}", re.I) for name in ("lang", "href"))


class Page(NamedTuple):
    text: str
    title: str | None
    lang: str | None
    links: list[str]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def scan_page(page: str) -> Page:
    """Text, title, language and links of a page, in one pass."""
    out, links, title, lang, at = [], [], None, None, 0
    while token := _TOKEN.search(page, at):
        out.append(page[at : token.start()])
        at = token.end()
        comment, closing, name, rest = token.groups()
        if comment:
            out.append(" ")
            at = page.find("-->", at) + 3
            if at == 2:
                at = len(page)
        elif name:
            name = name.lower()
            if name in _BREAKS:
                out.append("\n")
            elif closing:
                pass
            elif name in _RAW:
                out.append(" ")
                end = _RAW[name].search(page, at)
                if name == "title" and title is None and end:
                    title = html.unescape(page[at : end.start()]).strip()
                at = end.start() if end else len(page)
            elif name == "a" and (found := _HREF.search(rest)):
                links.append(html.unescape(found[1]))
            elif name == "html" and lang is None and (found := _LANG.search(rest)):
                lang = found[1]
    out.append(page[at:])
    lines = (x.strip() for x in _BLANKS.sub(" ", html.unescape("".join(out))).split("\n"))
    return Page("\n".join(x for x in lines if x), title, lang, links)


def header_lines(headers: str | None) -> list[tuple[str, str]]:
    """Names and values of HTTP headers, without the first line."""
    return [(name, value) for name, part, value in (x.partition(": ") for x in (headers or "").split("\r\n")[1:]) if part]


def page_metadata(page: Page, headers: str | None, fault: str | None = None) -> str:
    found = {"http_status": (headers or "").split("\r\n")[0], "http_headers": dict(header_lines(headers))}
    found |= {"title": page.title, "lang": page.lang, "links": page.links}
    return json.dumps(found | ({"fault": fault} if fault else {}), ensure_ascii=False)


def _unchunked(body: bytes) -> tuple[bytes, str | None]:
    """The body without chunk sizes, and what is wrong with it."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) or body, "chunks are damaged"
        n = int(size, 16)
        if not n:
            return b"".join(out), None
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) < n:
            return b"".join(out), "chunks are cut short"
        at = end + 2 + n + 2


def _inflated(body: bytes, windows: tuple[int, ...]) -> tuple[bytes, str | None]:
    """The decompressed body, by the first way that gives anything, and what is wrong with it."""
    for bits in windows:
        out, rest = [], body
        try:
            while rest:
                one = zlib.decompressobj(bits)
                out.append(one.decompress(rest) + one.flush())
                if not one.eof:
                    return b"".join(out), "the body is cut short"
                rest = one.unused_data
            return b"".join(out), None
        except zlib.error:
            if any(out):
                return b"".join(out), "the body is damaged"
    return body, "the body is damaged"


_META = re.compile(rb"<meta[^>]{0,200}?charset\s{0,9}=\s{0,9}[\"']?([\w:.-]{1,40})", re.I)


def decoded(payload: bytes, headers: str | None) -> tuple[bytes, str, str | None]:
    """The payload without chunking, its text, and what was wrong with it."""
    named = {name.lower(): value for name, value in header_lines(headers)}
    fault = None
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload, fault = _unchunked(payload)
    body = payload
    for coding in reversed([x.strip().lower() for x in named.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip"):
            body, wrong = _inflated(body, (31,))
        elif coding == "deflate":
            body, wrong = _inflated(body, (15, -15))
        else:
            wrong = None if coding in ("", "identity") else f"no way to undo {coding}"
        fault = fault or wrong
    told = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", named.get("content-type", ""), re.I)
    meta = _META.search(body, 0, 4096)
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return payload, body.decode(name, "replace"), fault
    for name in (told and told[1], meta and meta[1].decode()):
        try:
            if name and not isinstance(text := body.decode(name, "replace"), bytes):
                return payload, text, fault
        except (LookupError, UnicodeError):
            fault = fault or f"no charset {name}"
    return payload, body.decode("utf-8", "replace"), fault


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            payload, text, wrong = decoded(r["payload"] or b"", r["http_headers"])
            source, fault = digest(payload), r["fault"] or wrong
            page = scan_page(text)
            made = (("metadata", "application/json", page_metadata(page, r["http_headers"], fault)), ("conversion", "text/plain", page.text))
            for kind, content, block in made:
                data = block.encode("utf-8", "replace")
                own = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['record_id']}#{kind}").urn
                rows.append(
                    (r["page_id"], f"<{own}>", kind, r["record_id"], r["target_uri"], r["warc_date"], content, len(data), digest(data), source, r["http_headers"], data.decode(),
                     r["source_payload_digest"], r["source_block_digest"], fault)
                )
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def responses_of_pages(pages: DataFrame, fetched_at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records with headers of their own."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    key = F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.sha2(F.coalesce("html", F.lit("")), 256)), 256)
    if rows.groupBy(key).count().filter("count > 1").isEmpty():
        keyed = rows.withColumn("key", key)
    else:
        numbered = written(rows.withColumn("number", F.monotonically_increasing_id()), "pages")
        keyed = numbered.withColumn("key", F.sha2(F.concat_ws("|", key, F.col("number").cast("string")), 256))
    part = lambda a, n: F.substring("key", a, n)
    ident = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size)
    return keyed.select(
        "page_id",
        ident.alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(fetched_at).alias("warc_date"),
        headers.alias("http_headers"),
        F.col("html").cast("binary").alias("payload"),
        *[F.lit(None).cast("string").alias(c) for c in RESPONSE[6:]],
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two linked records per response (columns ``RESPONSE``) that has a payload or no fault."""
    usable = responses.filter("payload is not null or fault is null")
    return usable.select(*RESPONSE).withColumn("payload", F.col("payload").cast("binary")).mapInArrow(_derive, SCHEMA)


def to_bytes(row: dict) -> bytes:
    """One record in WARC/1.1 format; the source's HTTP headers come as X-Source-... headers."""
    block = row["block"].encode()
    source = (row["http_headers"] or "").split("\r\n")
    named = [
        ("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]),
        ("X-Source-Payload-Digest", row["payload_digest"]), ("X-Source-WARC-Payload-Digest", row.get("source_payload_digest")),
        ("X-Source-WARC-Block-Digest", row.get("source_block_digest")), ("X-Source-Status", source[0] or None),
        *((f"X-Source-{name}", value) for name, value in header_lines(row["http_headers"])),
        ("Content-Type", row["content_type"]), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in named if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


_MAGIC = b"\x1f\x8b\x08"


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """A file's gzip members one after the other, each with what is wrong with it; the file itself if it is not compressed.

    After a damaged member, reading goes on at the next start of one.
    """
    if not data.startswith(_MAGIC[:2]):
        if data:
            yield data, None
        return
    while data:
        one = zlib.decompressobj(31)
        try:
            out = one.decompress(data)
            if not one.eof:
                yield out, "a gzip member is cut short"
                return
            yield out, None
            rest = one.unused_data
        except zlib.error:
            yield b"", "a gzip member is damaged"
            rest = data[1:]
        at = rest.find(_MAGIC)
        data = rest[at:] if at >= 0 else b""


def from_bytes(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(headers, block, fault) of each record in a WARC file, compressed or not; header names are in lower case.

    A record whose length cannot be read has no block, and ends its member or file; one
    that is cut short has what there is.
    """
    for member, wrong in members(data):
        at = len(member) - len(member.lstrip(b"\r\n"))
        if wrong and b"\r\n\r\n" not in member:
            yield {}, None, wrong
        while (end := member.find(b"\r\n\r\n", at)) >= 0:
            lines = member[at:end].decode(errors="replace").lstrip("\r\n").split("\r\n")
            named = {name.strip().lower(): value.strip() for name, part, value in (x.partition(":") for x in lines[1:]) if part}
            if not re.fullmatch(r"[0-9]{1,18}", named.get("content-length", "")):
                yield named, None, "a record has no length"
                break
            size = int(named["content-length"])
            block = member[end + 4 : end + 4 + size]
            yield named, block, (wrong or "a record is cut short") if len(block) < size else None
            at = end + 4 + size + 4


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), *[pa.string()] * 3]
    for batch in batches:
        for content in batch["content"]:
            rows: list[tuple] = []
            for named, block, fault in from_bytes(content.as_py()):
                if fault or named.get("warc-type", "").lower() == "response":
                    head, _, payload = (None, None, None) if block is None else block.partition(b"\r\n\r\n")
                    own = (named.get(k) for k in ("warc-record-id", "warc-target-uri", "warc-date"))
                    given = (named.get(k) for k in ("warc-payload-digest", "warc-block-digest"))
                    if named.get("warc-type", "response").lower() == "response":
                        rows.append((None, *own, None if head is None else head.decode(errors="replace"), payload, *given, fault))
            for k in range(0, len(rows), 100):
                columns = zip(*rows[k : k + 100], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(RESPONSE))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files; page_id is null.

    One file is read by one task as a whole, so files are of the usual size of a gigabyte; Spark's limit is two.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_responses, _RESPONSES)


def _serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["record_id"], pa.array([to_bytes(r) for r in batch.to_pylist()], pa.binary())], ["record_id", "record"])


def serialized(records: DataFrame) -> DataFrame:
    """record_id and the record's bytes, ready to be written as WARC members."""
    return records.mapInArrow(_serialize, "record_id string, record binary")
