"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response record yields a metadata record (title, charset, outlinks, the source's HTTP headers)
and a conversion record (the page's plain text). Both refer to the response by its record id, keep
its target, date and digests, and have ids that follow from it, so that a task that is run again
writes the same records. Records are handled one by one, in the tasks that read them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|svg)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<[!?/][^>]*>")
_BLOCK = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split())
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HREF = re.compile(r"<a\s(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*?\bhref\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s\"'<>]+))", re.I)
_META = re.compile(rb"<meta\b[^<>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_SPACE = re.compile(r"[^\S\n]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length is added. Line breaks in values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines of a WARC or HTTP head without its first line; folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def unpacked(data: bytes) -> tuple[bytes, bool]:
    """Data without gzip (a member each or one for all), and whether some of it couldn't be read."""
    damaged = False
    while data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                parts.append(member.decompress(rest))
            except zlib.error:
                damaged = True
                break
            damaged |= not member.eof  # cut short
            rest = member.unused_data
        else:
            damaged |= bool(rest.strip(b"\x00"))
        data = b"".join(parts)
    return data, damaged


def parsed(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes] | None]:
    """(headers, block) of each record; None for each stretch that is no record, or one cut short.
    Reading goes on at the next line that begins a record."""
    data, damaged = unpacked(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        head = fields(data[data.find(b"\r\n", at) + 2 : end]) if end >= 0 else []
        size = get(head, "Content-Length") or ""
        stop = end + 4 + int(size) if size.isdigit() else -1
        # a record that was cut short reaches into the next one
        if 0 <= stop <= len(data) and (stop == len(data) or data.startswith((b"\r\n", b"WARC/"), stop)):
            yield head, data[end + 4 : stop]
            at = stop
            while data.startswith(b"\r\n", at):
                at += 2
        else:
            damaged = False
            yield None
            then = data.find(b"\r\nWARC/", at)
            at = then + 2 if then >= 0 else len(data)
    if damaged:
        yield None


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each whole record in plain or gzipped data."""
    return (r for r in parsed(data) if r is not None)


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response(key: str, url: str | None, page: str | None) -> bytes:
    """A response record of one page."""
    body = (page or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>"), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", url)] if url else []
    return serialise([*head, ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(http)), ("WARC-Payload-Digest", digest(body))], http)


def plain(page: str) -> str:
    """Visible text: a line for each block of the page that has any."""
    page = _DROP.sub(" ", page)
    text = _TAG.sub(lambda m: "\n" if (m[2] or "").lower() in _BLOCK else "", page.replace("\r", " ").replace("\n", " "))
    lines = (line.strip() for line in _SPACE.sub(" ", html.unescape(text)).split("\n"))
    return "\n".join(line for line in lines if line)


def _title(page: str) -> str | None:
    """What stands in the first title element; None where none is closed. One way forward: where the
    first one isn't closed, no later one is."""
    start = _TITLE.search(page)
    end = _TITLE_END.search(page, start.end()) if start else None
    return page[start.end() : end.start()] if start and end else None


def payload(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body without transfer and content codings) of an HTTP response."""
    end = block.find(b"\r\n\r\n")
    head, body = (block[:end], block[end + 4 :]) if end >= 0 else (b"", block)
    first, _, rest = head.partition(b"\r\n")
    headers = fields(rest)
    if "chunked" in (get(headers, "Transfer-Encoding") or "").lower():
        out, at = [], 0
        while (stop := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:stop].split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            out.append(body[stop + 2 : stop + 2 + n])
            at = stop + 4 + n
        body = b"".join(out) if out else body
    coding = (get(headers, "Content-Encoding") or "").lower()
    try:
        body = gzip.decompress(body) if "gzip" in coding else zlib.decompress(body) if "deflate" in coding else body
    except (OSError, EOFError, zlib.error):
        pass  # said to be coded, but isn't
    return first.decode("utf-8", "replace"), headers, body


def charset(headers: list[tuple[str, str]], body: bytes) -> str:
    said = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", get(headers, "Content-Type") or "", re.I)
    inside = None if said else _META.search(body)
    name = said[1] if said else inside[1].decode() if inside else "utf-8"
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name.lower()


COLUMNS = ("warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "digest_ok", "content_length", "block", "record")
SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, digest_ok boolean, content_length long, block string, record binary"


def derive(head: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and the conversion record (COLUMNS) of a response record; none of others."""
    if (get(head, "WARC-Type") or "").lower() != "response":
        return []
    source, target = get(head, "WARC-Record-ID") or "", get(head, "WARC-Target-URI")
    status, http, body = payload(block)
    name = charset(http, body)
    page = body.decode(name, "replace")
    said, own = get(head, "WARC-Block-Digest"), digest(block)
    known = get(head, "WARC-Payload-Digest") or digest(body)
    ok = said is None or not said.lower().startswith("sha1:") or said == own
    title = _title(page)
    one = lambda v: re.sub(r"\s+", " ", v).strip()
    lines = [("title", one(html.unescape(title)))] if title is not None else []
    lines += [("charset", name), ("source-status", status), *((f"source-{k.lower()}", v) for k, v in http)]
    lines += [("source-payload-digest", known), ("source-block-digest", said or own), ("source-digest-verified", str(ok).lower())]
    for m in _HREF.finditer(page):
        link = one(html.unescape(m[1] or m[2] or m[3] or ""))
        try:
            lines.append(("outlink", urljoin(target or "", link)))
        except ValueError:
            lines.append(("outlink", link))
    about = "".join(f"{k}: {one(v)}\r\n" for k, v in lines)
    out = []
    for kind, media, text in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", plain(page))):
        data = text.encode("utf-8", "replace")
        record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", source), ("WARC-Date", get(head, "WARC-Date") or DATE)]
        headers += [("WARC-Target-URI", target)] if target else []
        headers += [("WARC-Refers-To-Payload-Digest", known), ("WARC-Block-Digest", digest(data)), ("Content-Type", media)]
        out.append((kind, record_id, source, target, known, digest(data), ok, len(data), text, serialise(headers, data)))
    return out


def responses(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, record) a response record of each page. A null url has no target, a null page no body;
    repeated rows give equal records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(str(k), u, h) for k, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[key, "record"])

    return pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, f"`{key}` long, record binary")


def derivatives(source: DataFrame, key: str = "page_id") -> DataFrame:
    """A row of COLUMNS, after the key, for each record derived from the WARC data in `record`.

    Data may hold several records, gzipped or not; what isn't a response gives none, and so do
    null, empty and damaged data: damage() tells how much there is of that. Other columns are not
    looked at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                b = whole.slice(a, 200)
                keys, rows = [], []
                for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for head, block in records(data or b""):
                        new = derive(head, block)
                        rows += new
                        keys += [k] * len(new)
                cols = list(zip(*rows)) or [[]] * len(COLUMNS)
                types = [pa.string()] * 6 + [pa.bool_(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *COLUMNS])

    return source.select(F.col(key).cast("long").alias(key), F.col("record").cast("binary").alias("record")).mapInArrow(work, f"`{key}` long, {SCHEMA}")


def damage(source: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, n_records, n_damaged) of the WARC data in `record`: whole records, and stretches that
    are none or are cut short. Null and empty data have neither."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[r is None for r in parsed(data or b"")] for data in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) - sum(f) for f in found], pa.int64()), pa.array([sum(f) for f in found], pa.int64())], names=[key, "n_records", "n_damaged"])

    return source.select(F.col(key).cast("long").alias(key), F.col("record").cast("binary").alias("record")).mapInArrow(work, f"`{key}` long, n_records long, n_damaged long")
