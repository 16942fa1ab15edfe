"""WARC derivatives: metadata and plain-text conversion records of response records.

The metadata record keeps every header of its source: the HTTP status line, each HTTP
header line and each WARC header line, block digest included, in their order. A folded
header is kept as one line.

Defined results: a null page body counts as empty; a null url gives an empty target; rows
that repeat give repeated records with equal ids; an empty table gives an empty result;
columns but the three named are not read. A comment, script, style or head that never ends
is read as if its opening tag stood alone; a "<" without ">" is text. Titles and links in
comments, scripts and styles do not count. A page is scanned once, in time linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

DATE = "2024-01-01T00:00:00Z"
#: Tags at which a line of plain text ends, and elements whose content is not text.
BREAKS = frozenset("br p div h1 h2 h3 h4 h5 h6 li ul ol tr article nav footer".split())
OPAQUE = frozenset(("script", "style"))
_name = re.compile(r"<(/?)([a-z][a-z0-9]*)(?![a-z0-9])", re.I)
_href = re.compile(r"""[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, url: str, payload: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {url} {digest(payload)}')}>"


def scan(body: str) -> tuple[str, str, list[str]]:
    """(plain text, title, link targets) of a page."""
    low = body.lower() if len(body.lower()) == len(body) else "".join(c.lower() if len(c.lower()) == 1 else c for c in body)
    absent: set[str] = set()

    def after(what: str, at: int) -> int:
        """The end of the next ``what``, -1 if there is none; what was once not found is not sought again."""
        if what in absent:
            return -1
        found = low.find(what, at)
        if found < 0:
            absent.add(what)
            return -1
        return found + len(what)

    out, title, links, at, in_head = [], None, [], 0, -1
    while True:
        tag = low.find("<", at)
        if tag < 0:
            break
        if tag >= in_head:
            out.append(body[at:tag])
        close = after("-->", tag + 4) if low.startswith("<!--", tag) else -1
        if close >= 0:
            at = close
            continue
        close = after(">", tag)
        if close < 0:
            at = tag
            break
        named = _name.match(body, tag, close)
        name = named[2].lower() if named else ""
        at = close
        if name in BREAKS:
            if tag >= in_head:
                out.append("\n")
        elif named and not named[1]:
            end = after(f"</{name}", close) if name in OPAQUE or name in ("title", "head") else -1
            if end >= 0 and name == "head":
                in_head = max(in_head, end)
            elif end >= 0:
                if name == "title" and title is None:
                    title = body[close : end - len(name) - 2]
                past = after(">", end)
                at = past if past >= 0 else end
            elif name == "a" and (link := _href.match(body, named.end(), close)):
                links.append(link[1])
    if at >= in_head:
        out.append(body[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), " ".join(html.unescape(title or "").split()), links


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of header lines, repeated ones too; continuation lines are folded in."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line.strip():
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Records of uncompressed WARC bytes: (header fields, block)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        found = fields(lines)
        size = int(next(v for k, v in found if k.lower() == "content-length"))
        yield found, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records of uncompressed WARC bytes: (headers, block), of a repeated header the last."""
    return [(dict(found), block) for found, block in records(data)]


def response(url: str | None, body: str | None, date: str = DATE) -> bytes:
    payload, url = (body or "").encode("utf-8", "replace"), url or ""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, payload)), ("WARC-Date", date), ("WARC-Target-URI", " ".join(url.split())),
         ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http;msgtype=response")],
        block,
    )


def derive(source: bytes) -> list[tuple[str, str, str, bytes]]:
    """(type, record id, refers-to, record bytes) of the metadata and the conversion of every response in ``source``."""
    out = []
    for found, block in records(source):
        if {k.lower(): v for k, v in found}.get("warc-type") == "response":
            out += _derive_one(found, block)
    return out


def _derive_one(found: list[tuple[str, str]], block: bytes) -> list[tuple[str, str, str, bytes]]:
    headers = {k.lower(): v for k, v in found}
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    status, *http_lines = http.decode(errors="replace").split("\r\n")
    body, of, url, date = payload.decode("utf-8", "replace"), headers["warc-record-id"], headers.get("warc-target-uri", ""), headers["warc-date"]
    text, title, found_links = scan(body)
    links = [f"outlink: {' '.join(x.split())}" for x in found_links]
    kept = [f"source-{kind}-header: {k}: {v}" for kind, group in (("http", fields(http_lines)), ("warc", found)) for k, v in group]
    about = "\r\n".join([f"title: {title}", f"source-payload-digest: {headers.get('warc-payload-digest', '')}", f"source-http: {status}", *kept, *links, ""]).encode()
    out = []
    for kind, kind_type, data in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text.encode())):
        # A source with an id of its own gives ids of its own, so equal pages of one input stay apart.
        own = record_id(kind, url, payload) if of == record_id("response", url, payload) else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {of}')}>"
        out.append((kind, own, of, record(
            [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", of), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date),
             ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", digest(data)), ("Content-Type", kind_type)], data)))
    return out


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """page_id, type, record_id, refers_to, record binary: two rows a page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
                rows = [(i, *d) for i, u, h in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True) for d in derive(response(u, h))]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "type", "record_id", "refers_to", "record"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(body_col).alias("html")).mapInArrow(
        run, "page_id long, type string, record_id string, refers_to string, record binary"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, type, record_id, refers_to, record_bytes, record_sha256 of every derived record."""
    return derivatives(read_table(spark, sf_dir, "pages")).select(
        "page_id", "type", "record_id", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256")
    )
