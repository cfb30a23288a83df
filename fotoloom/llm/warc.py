"""WARC: derivative builder.

Each ``response`` record becomes two records that refer to it: ``metadata`` (a
warc-fields block with the HTTP status, every source header, title, charset, links and
the source's digests) and ``conversion`` (the payload as UTF-8 plain text). Both carry
WARC-Refers-To with the response's identifier, its target URI and date; the conversion
names its metadata record in WARC-Concurrent-To. Identifiers are name-based (version 5)
UUIDs of the source identifier and type, so reruns give the same records.

Defined results: record types other than response give nothing; null or empty input
gives nothing; a response whose HTTP head can't be read gives a metadata record with an
``error`` field and no conversion; so does a body that its content encoding can't undo.
So do bytes that are no record: what a damaged
or cut off gzip member leaves undecoded, and a record shorter than its Content-Length (what came before is derived as usual).
A response without an identifier gets the UUID of its bytes. Missing source digests are
computed, given ones are kept as they are, with a field that says whether they hold.
A null url is an empty target URI; repeated rows give equal records; columns other than
``key`` and ``record`` are ignored.

Scale: a map over the records, without a shuffle; a record is held in memory whole. Reading a page takes time in
proportion to its length, whatever is left open in it: a mark that isn't found ahead is not looked for again.
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_chunks

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fotoloom:warc")
SCHEMA = (
    "key long, record_no int, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_block_digest string, source_payload_digest string, record binary"
)

#: What begins a stretch that is no text: a comment, a declaration, or an element whose content isn't shown.
_HIDDEN = re.compile(r"<(?:(!--)|(!)|(script|style|noscript|template|head)(?![\w-]))", re.I)
_BREAKS = "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split()
#: A tag: of a block element (1), the start of a title or link (2), or any other. Only for text that ends with ``>``, where every try finds its end.
_TAG = re.compile(rf"<(?:/?({'|'.join(_BREAKS)})(?=[\s/>])|(title|a)(?=[\s/>])|/?[A-Za-z])[^>]*>", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE_END = re.compile(r"</title\s*>", re.I)
_HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_META_CHARSET = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_HEADER_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Ahead:
    """``find`` for rising places: each mark is looked for once between two of its finds."""

    def __init__(self, s: str):
        self.s, self.known = s, {}

    def find(self, mark, start: int) -> tuple[int, int]:
        """(begin, end) of the next mark, a string or pattern, from ``start`` on; (-1, -1) if there is none."""
        at = self.known.get(mark)
        if at is None or 0 <= at[0] < start:
            if isinstance(mark, str):
                i = self.s.find(mark, start)
                at = (i, i + len(mark)) if i >= 0 else (-1, -1)
            else:
                m = mark.search(self.s, start)
                at = m.span() if m else (-1, -1)
            self.known[mark] = at
        return at


def _shown(page: str) -> str:
    """The page with a space for each comment, declaration and hidden element; those that never end stay."""
    ahead, out, at, kept = _Ahead(page), [], 0, 0
    while m := _HIDDEN.search(page, at):
        end, at = -1, m.end()
        if m[1]:
            end = ahead.find("-->", m.end())[1]
        if end < 0 and (m[1] or m[2]):
            end = ahead.find(">", m.end())[1]
        if m[3]:
            opened = ahead.find(">", m.end())[1]
            end = ahead.find(_closing(m[3].lower()), opened)[1] if opened >= 0 else -1
        if end >= 0:
            out += [page[kept : m.start()], " "]
            kept = at = end
    return "".join(out) + page[kept:]


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def plain_text(page: str) -> str:
    """The readable text of an HTML page: no comments, scripts or head; block elements end lines."""
    s = _shown(page.replace("\n", " "))
    end = s.rfind(">") + 1
    text = _TAG.sub(lambda m: "\n" if m[1] else "", s[:end]) + s[end:]
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip()


def title_and_links(page: str) -> tuple[str, list[str]]:
    title, links = None, []
    for m in _TAG.finditer(page[: page.rfind(">") + 1]):
        if m[2] is None:
            continue
        if len(m[2]) == 1:
            if href := _HREF.search(page, m.start(), m.end()):
                links.append("".join(x or "" for x in href.groups()))
        elif title is None:
            closed = _TITLE_END.search(page, m.end())
            title = page[m.end() : closed.start()] if closed else ""
    tidy = lambda x: " ".join(html.unescape(x).split())
    return tidy(title or ""), [tidy(x) for x in links]


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            k, v = text.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _head_end(data: bytes, start: int) -> tuple[int, int]:
    """Where the head that begins at ``start`` ends, and where its block begins; -1 if it doesn't end."""
    found = [(at, at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := data.find(mark, start)) >= 0]
    return min(found, default=(-1, -1))


def _inflate(data: bytes) -> tuple[bytes, bytes, str]:
    """What the gzip members of ``data`` hold, the bytes that are left when one can't be read on, and why."""
    out, rest = [], data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(rest))
        except zlib.error as e:
            return b"".join(out), rest, f"damaged gzip member: {e}"
        if not member.eof:
            return b"".join(out), rest, "gzip member cut off"
        rest = member.unused_data
    return b"".join(out), b"", ""


def decode_records(data: bytes):
    """(headers, block, error) for each record of a WARC file's bytes, gzipped by record or plain; what is no record has an error."""
    rest, error = b"", ""
    if data[:2] == b"\x1f\x8b":
        data, rest, error = _inflate(data)
    at = data.find(b"WARC/")
    if at < 0 and data.strip():
        yield [("WARC-Type", "response")], data, "no WARC record"
    while at >= 0:
        end, block = _head_end(data, at)
        if end < 0:
            yield [("WARC-Type", "response")], data[at:], error or "record head cut off"
            return
        headers = _fields(data[at:end].split(b"\n", 1)[-1])
        given = dict((k.lower(), v) for k, v in headers).get("content-length", "")
        size = int(given) if given.isascii() and given.isdigit() else len(data) - block
        if block + size > len(data):
            yield headers, data[block:], error or "record cut off"
            return
        yield headers, data[block : block + size], ""
        at = data.find(b"WARC/", block + size)
    if error:
        yield [("WARC-Type", "response")], rest, error


def read_records(data: bytes):
    """(headers, block) of the records that can be read."""
    return ((headers, block) for headers, block, error in decode_records(data) if not error)


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\n", at)
        if line < 0:
            return b"".join(out)
        size = int(body[at:line].split(b";")[0].strip() or b"0", 16)
        if size < 0:
            raise ValueError("chunk of negative size")
        if size == 0:
            return b"".join(out)
        out.append(body[line + 1 : line + 1 + size])
        at = body.find(b"\n", line + 1 + size) + 1
        if at == 0:
            return b"".join(out)


def _decode(body: bytes, headers: dict[str, str]) -> tuple[str, str]:
    """The payload as text, and its charset."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = _unchunk(body)
    coding = headers.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        body = gzip.decompress(body)
    elif coding == "deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:
            body = zlib.decompress(body, -zlib.MAX_WBITS)
    elif coding not in ("", "identity"):
        raise ValueError(f"content encoding {coding}")
    said = _HEADER_CHARSET.search(headers.get("content-type", "")) or _META_CHARSET.search(body[:4096])
    charset = (said[1] if isinstance(said[1], str) else said[1].decode()) if said else "utf-8"
    try:
        return body.decode(charset, "replace"), charset.lower()
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def derive(headers: list[tuple[str, str]], block: bytes, error: str = "") -> list[dict]:
    """The derived records of one response; with an error that reading it met, only the metadata record that says so."""
    source = {k.lower(): v for k, v in headers}
    if source.get("warc-type", "").lower() != "response":
        return []
    rid = source.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(NAMESPACE, hashlib.sha256(block).hexdigest())}>"
    uri, date = source.get("warc-target-uri", ""), source.get("warc-date", DATE)
    end, at = _head_end(block, 0)
    status, http, text, charset, raw = "", [], None, "", ""
    body = block[at:] if end >= 0 else b""
    if error:
        pass
    elif end < 0 or not block.startswith(b"HTTP/"):
        error = "no HTTP head"
    else:
        status = block[: block.find(b"\n")].strip().decode("utf-8", "replace")
        http = _fields(block[block.find(b"\n") + 1 : end])
        try:
            raw, charset = _decode(body, {k.lower(): v for k, v in http})
            kind = dict((k.lower(), v) for k, v in http).get("content-type", "text/html").lower()
            text = plain_text(raw) if "html" in kind or "xml" in kind else raw
        except (ValueError, OSError, zlib.error, EOFError) as e:
            error = f"unreadable body: {e}"
    block_digest, payload_digest = source.get("warc-block-digest") or digest(block), source.get("warc-payload-digest") or digest(body)
    fields = [("source-record-id", rid), ("http-status", status), *(("source-header", f"{k}: {v}") for k, v in http), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("digests-hold", str(block_digest == digest(block) and payload_digest == digest(body)).lower())]
    if text is not None:
        title, links = title_and_links(raw)
        fields += [("charset", charset), ("title", title), *(("outlink", x) for x in links)]
    if error:
        fields.append(("error", " ".join(error.split())))
    names = {k: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{rid} {k}')}>" for k in ("metadata", "conversion")}
    out = []
    parts = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), [])]
    if text is not None:
        parts.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), [("WARC-Concurrent-To", names["metadata"])]))
    for i, (kind, content_type, data, more) in enumerate(parts):
        own = digest(data)
        head = [("WARC-Type", kind), ("WARC-Record-ID", names[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), *more, ("WARC-Block-Digest", own), ("Content-Type", content_type)]
        out.append({"record_no": i, "warc_type": kind, "record_id": names[kind], "refers_to": rid, "target_uri": uri, "warc_date": date, "content_type": content_type, "content_length": len(data), "block_digest": own, "source_block_digest": block_digest, "source_payload_digest": payload_digest, "record": write_record(head, data)})
    return out


def response_record(key, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A response record for a page that was fetched with status 200."""
    body = (page or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    rid = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key} {uri}')}>"
    head = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(head, block)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(record, key): a response record for each row of (page_id, url, html); null pages give none."""

    def build(batches):
        for batch in byte_chunks(batches, 8 << 20):
            cols = [batch.column(c).to_pylist() for c in ("html", "url", "page_id")]
            rows = [None if h is None else response_record(k, u, h.decode("utf-8", "replace"), date) for h, u, k in zip(*cols)]
            yield pa.record_batch([pa.array(rows, pa.binary()), batch.column("page_id")], names=["record", "key"])

    some = pages.select(F.col("html").cast("binary").alias("html"), F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"))
    return some.mapInArrow(build, "record binary, key long")


def derivatives(records: DataFrame) -> DataFrame:
    """The derived records of (record, key): ``record`` holds the bytes of one or more WARC records."""
    kinds = {"record_no": pa.int32(), "content_length": pa.int64(), "record": pa.binary()}

    def run(batches):
        for batch in byte_chunks(batches, 8 << 20):
            rows = []
            for data, key in zip(batch.column("record").to_pylist(), batch.column("key").to_pylist()):
                rows += [{"key": key} | r for found in decode_records(data or b"") for r in derive(*found)]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64() if c == "key" else kinds.get(c, pa.string())) for c in names], names=names)

    return records.select("record", "key").mapInArrow(run, SCHEMA)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return derivatives(responses(pages)).withColumnRenamed("key", "page_id")
