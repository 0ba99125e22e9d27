"""WARC (operator 4): derivative builder.

Response records become two linked derivatives each: a metadata record (JSON: the source record's WARC and HTTP
headers, all of them in their order, status, links, title) and a conversion record (plain text). Both name the response
in WARC-Refers-To, carry its target URI and date, its payload digest and their own block digest.

read_warc() reads the records of WARC files, plain or in gzip members, as rows; convert() builds the derivatives of their
responses; build_derivatives() does so for a table of pages, each taken as a response. Transfer and content encodings
(chunked, gzip, deflate) are undone and the charset that the headers or the page declare is used for the text; digests
are of the payload as it is in the record. A payload that doesn't decode is taken as it is, and the metadata says so.

Edge cases: a null URL gives an empty target URI, null html an empty payload; neither is dropped. Records that aren't
responses have no derivatives. Ids come from the content and the row's key, so reruns agree and repeated rows get equal
ids. An empty table gives an empty table; other input columns are not read. Each row stands alone: nothing is shuffled,
and a row's memory is a few times its page. A file is read by one task, which holds its bytes once and a record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm.common import as_bytes, slices
from silt.llm.html import parse

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:silt:warc")
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    """Labelled SHA-1 in base 32, as WARC digests are written."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join([kind, *map(str, parts)]))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record; Content-Length is set here. Line ends within a value become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers if k.lower() != "content-length"]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record; data may be gzip members, one after another, unpacked as records are read."""
    stream = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and headers:  # a header that goes on
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {text.strip()}")
                continue
            k, _, v = text.partition(":")
            headers.append((k, v.lstrip(" ")))
        size = int(dict((k.lower(), v) for k, v in headers)["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut short")
        yield headers, block


def response_record(page_id, url: str, payload: bytes, date: str = DATE) -> bytes:
    """A response record that holds payload as an HTTP reply."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\nX-Page-Id: {page_id}\r\n\r\n"
    ).encode()
    block = http + payload
    return write_record(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id("response", page_id, url, digest(payload))),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", digest(payload)),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP reply; a block without a header end is all headers."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def unchunked(data: bytes) -> bytes:
    """A body in chunks as one; ValueError if it isn't in chunks."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        if size < 0 or end + 2 + size > len(data):
            raise ValueError("a chunk is cut short")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def decoded(payload: bytes, http: list[tuple[str, str]]) -> tuple[bytes, str | None]:
    """The body without its transfer and content encodings; and the encoding that could not be undone, if any."""
    values = {k.lower(): v for k, v in reversed(http)}
    codes = [(x.strip().lower(), h) for h in ("content-encoding", "transfer-encoding") for x in values.get(h, "").split(",") if x.strip()]
    for code, _ in reversed(codes):
        try:
            if code == "chunked":
                payload = unchunked(payload)
            elif code in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif code == "deflate":
                try:
                    payload = zlib.decompress(payload)
                except zlib.error:
                    payload = zlib.decompress(payload, -15)
            elif code != "identity":
                return payload, code
        except (ValueError, OSError, EOFError, zlib.error):
            return payload, code
    return payload, None


_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def text_of(body: bytes, http: list[tuple[str, str]]) -> str:
    """The body as text, in the charset that its headers name, else that its first KB names, else UTF-8."""
    declared = next((m[1] for k, v in http if k.lower() == "content-type" and (m := _CHARSET.search(v))), None)
    if body[:3] == b"\xef\xbb\xbf":
        declared, body = "utf-8", body[3:]
    elif not declared and (m := _CHARSET.search(body[:1024].decode("latin-1"))):
        declared = m[1]
    try:
        return body.decode(declared or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


_LINK = re.compile(r"<(a|img|link|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)


def derive(response: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of the metadata and of the conversion record of one response record."""
    return _linked(*next(read_records(response)))


def _linked(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    source = {k.lower(): v for k, v in headers}
    if source.get("warc-type") != "response":
        raise ValueError("derivatives are built from response records")
    status, http, payload = split_http(block)
    of, of_payload = source["warc-record-id"], digest(payload)
    linked = [
        ("WARC-Refers-To", of),
        ("WARC-Refers-To-Target-URI", source.get("warc-target-uri", "")),
        ("WARC-Refers-To-Date", source.get("warc-date", "")),
        ("WARC-Date", source.get("warc-date", "")),
        ("WARC-Target-URI", source.get("warc-target-uri", "")),
        ("WARC-Source-Payload-Digest", of_payload),
    ]
    body, stuck = decoded(payload, http)
    html = text_of(body, http)
    title = _TITLE.search(html)
    about = {
        "warc": headers,
        "http": {"status": status, "headers": http},
        "payload": {"length": len(payload), "digest": of_payload, "declared": source.get("warc-payload-digest")}
        | ({"undecoded": stuck} if stuck else {}),
        "html": {
            "title": " ".join(unescape(title[1]).split()) if title else None,
            "links": [[t.lower(), unescape(a or b or c)] for t, a, b, c in _LINK.findall(html)],
        },
    }
    meta = json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    text = "\n".join(parse(html).lines).encode("utf-8", "surrogatepass")
    out = []
    for kind, mime, body in (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, of)), *linked]
        out.append(([*own, ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body))
    return out


DERIVED = (
    "response_id string, metadata_id string, conversion_id string, refers_to string,"
    " source_date string, payload_digest string, metadata_digest string, conversion_digest string, http_status string,"
    " http_headers map<string,string>, metadata string, text string, n_chars bigint, records binary"
)
RECORDS = "path string, place bigint, headers array<struct<name:string,value:string>>, block binary"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_TYPES["array<struct<name:string,value:string>>"] = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(", ")])


def _derived(source: list[tuple[str, str]], block: bytes) -> tuple:
    """The values of DERIVED for a response."""
    derived = _linked(source, block)
    (m, mb), (c, cb) = derived
    records = b"".join(gzip.compress(write_record(*x), 1, mtime=0) for x in derived)
    m, c = dict(m), dict(c)
    status, http, _ = split_http(block)
    named: dict[str, str] = {}
    for k, v in http:
        named[k] = f"{named[k]}, {v}" if k in named else v
    text = cb.decode("utf-8", "replace")
    return (
        m["WARC-Refers-To"], m["WARC-Record-ID"], c["WARC-Record-ID"], c["WARC-Refers-To"], c["WARC-Refers-To-Date"],
        c["WARC-Source-Payload-Digest"], m["WARC-Block-Digest"], c["WARC-Block-Digest"], status, list(named.items()),
        mb.decode("utf-8", "replace"), text, len(text), records,
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(PAGES)
    for batch in batches:
        for part in slices(batch, ["html"], 1 << 20):
            ids, urls, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))
            rows = [(i, url, *_derived(*next(read_records(response_record(i, url or "", html))))) for i, url, html in zip(ids, urls, texts)]
            yield _batch(rows, schema)


PAGES = f"page_id bigint, url string, {DERIVED}"


def build_derivatives(pages: DataFrame) -> DataFrame:
    """For every row of pages (page_id, url, html) taken as a response: its two derivatives, parsed and as gzip members."""
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(_derive, PAGES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(RECORDS)
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            path, rows, size = path.as_py(), [], 0
            for k, (headers, block) in enumerate(read_records(memoryview(content.as_buffer()).tobytes())):
                rows.append((path, k, [{"name": n, "value": v} for n, v in headers], block))
                size += len(block)
                if size > 4 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records of WARC files: path, place in the file, headers in their order, block."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_read, RECORDS)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(CONVERTED)
    for batch in batches:
        for part in slices(batch, ["block"], 1 << 20):
            rows = []
            for path, place, headers, block in zip(*(c.to_pylist() for c in part.columns)):
                headers = [(h["name"], h["value"]) for h in headers]
                url = next((v for n, v in headers if n.lower() == "warc-target-uri"), None)
                rows.append((path, place, url, *_derived(headers, block)))
            yield _batch(rows, schema)


CONVERTED = f"path string, place bigint, url string, {DERIVED}"


def convert(records: DataFrame) -> DataFrame:
    """The derivatives of the responses among records (see read_warc), with the path and place of each."""
    kind = F.filter("headers", lambda h: F.lower(h["name"]) == "warc-type")
    http = F.filter("headers", lambda h: (F.lower(h["name"]) == "content-type") & h["value"].startswith("application/http"))
    wanted = records.where((F.get(kind, F.lit(0))["value"] == "response") & (F.size(http) > 0))
    return wanted.select("path", "place", "headers", F.coalesce("block", F.lit(b"")).alias("block")).mapInArrow(_convert, CONVERTED)

