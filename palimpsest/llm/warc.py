"""WARC derivatives: responses to linked metadata and plain-text conversion records (WARC 1.1, ISO 28500:2017).

Each response gives a metadata record (title, outlinks, the source's HTTP headers and digests, as warc-fields) and a
conversion record (the page's whole text, a line a block). Both carry WARC-Refers-To, -Target-URI and -Date of the
response; record ids are name-based UUIDs of the response's id, so a rerun after a lost executor gives the same ids.

Before a payload is read, chunks and gzip or deflate codings are undone, and it is decoded by its byte order mark, the
charset of its header or that of its meta element; without any as UTF-8, or windows-1252 where it isn't valid UTF-8.
Digests are of the bytes as they came. A payload of another coding (br, zstd), or one that its coding can't undo, gives
an empty page, and its metadata an `undecoded` field.

Edge cases: null html is an empty payload; a null url leaves out the target URI; repeated pages give equal records;
a block that is no HTTP response is taken as a payload without headers; a record that is cut off or has no valid length
gives no derivative (read_warc gives its fault); an empty table gives no record.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .html_text import plain_text, read

VERSION = b"WARC/1.1"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_START = re.compile(rb"WARC/\d+\.\d+\r\n")
_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n")
_HEADER_CHARSET = re.compile(r"(?i)\bcharset\s*=\s*[\"']?([\w.:-]+)")
_META_CHARSET = re.compile(rb"(?i)<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w.:-]+)", re.ASCII)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, RFC 9562


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers).encode() + b"\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(names))}>"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(kind: str, rid: str, date: str, content_type: str, block: bytes, more: list[tuple[str, str | None]]) -> Record:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date)]
    headers += [(k, _one_line(v)) for k, v in more if v is not None]
    return Record([*headers, ("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))], block)


def response(url: str | None, payload: bytes, date: str, key: str) -> Record:
    """The response record of a fetched page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record("response", record_id("response", key, digest(payload)), date, "application/http; msgtype=response", http + payload, [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(payload))])


def parse(data: bytes, faults: list[str] | None = None) -> Iterator[Record]:
    """The records of a WARC file's bytes; a record ends where its Content-Length says, whatever its block holds.

    A record that is cut off or whose length isn't a number is left out, its fault is added to faults, and reading goes
    on with the next start of a record.
    """
    faults, at = [] if faults is None else faults, 0
    while m := _START.search(data, at):
        end = data.find(b"\r\n\r\n", m.start())
        if end < 0:
            faults.append("header cut off")
            return
        headers: list[tuple[str, str]] = []
        for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
            if line[:1] in (" ", "\t") and headers:  # folded
                headers[-1] = headers[-1][0], f"{headers[-1][1]} {line.strip()}"
            elif line:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        size, at = next((v for k, v in headers if k.lower() == "content-length"), ""), end + 4
        if not (size.isascii() and size.isdigit()):
            faults.append("no valid Content-Length")
        elif len(data) < at + int(size):
            faults.append("block cut off")
        else:
            yield Record(headers, data[at : at + int(size)])
            at += int(size)


def inflate(data: bytes) -> bytes:
    """data, or what its gzip members hold; of a damaged member what comes before the damage."""
    out, at = [], 0
    while (at := data.find(b"\x1f\x8b\x08", at) if out else 0 if data[:2] == b"\x1f\x8b" else -1) >= 0:
        z = zlib.decompressobj(31)
        try:
            for i in range(at, len(data), 1 << 16):
                out.append(z.decompress(data[i : i + (1 << 16)]))
                if z.eof:
                    break
            at = min(len(data), i + (1 << 16)) - len(z.unused_data) if z.eof else len(data)
        except zlib.error:
            out.append(b"")
            at += 3
    return b"".join(out) if out else data


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def _values(http: list[tuple[str, str]], name: str) -> list[str]:
    """The comma-separated values of a header, lower-case."""
    return [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",") if x.strip()]


def unchunked(data: bytes) -> bytes:
    """data without the marks of its chunks; data itself where there are none (archives may have taken them out)."""
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m[1], 16)
        out.append(data[m.end() : m.end() + size])
        if size == 0 or m.end() + size >= len(data):
            return b"".join(out)
        at = m.end() + size + 2
    return b"".join(out) if out and at >= len(data) else data


def uncoded(data: bytes, coding: str) -> bytes | None:
    """data with a content coding undone, as far as the bytes go; None where it can't be."""
    if coding == "identity" or not data:
        return data
    if coding in ("gzip", "x-gzip"):
        if data[:2] != b"\x1f\x8b":
            return data  # undone by the archive already
        kinds = [31]
    elif coding == "deflate":
        kinds = [15, -15]
    elif coding in ("br", "zstd", "compress", "x-compress"):
        return data if data.lstrip()[:1] == b"<" else None
    else:
        return data  # no coding: servers send charsets and such
    for bits in kinds:
        out, rest = [], data
        try:
            while rest and (not out or rest[:2] == b"\x1f\x8b"):
                z = zlib.decompressobj(bits)
                for i in range(0, len(rest), 1 << 16):
                    out.append(z.decompress(rest[i : i + (1 << 16)]))
                    if z.eof:
                        break
                rest = z.unused_data + rest[i + (1 << 16) :]
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return data if data.lstrip()[:1] == b"<" else None


def _charset(label: str) -> str | None:
    """Python's name of a charset; iso-8859-1 and ASCII are windows-1252 on the web."""
    try:
        found = codecs.lookup(label.strip("\"' "))
    except (LookupError, ValueError):
        return None
    return None if not found._is_text_encoding else "cp1252" if found.name in ("iso8859-1", "ascii") else found.name


def decoded(payload: bytes, http: list[tuple[str, str]]) -> tuple[str, str | None]:
    """The text of a payload, and the coding that could not be undone."""
    for coding in _values(http, "transfer-encoding")[::-1] + _values(http, "content-encoding")[::-1]:
        undone = unchunked(payload) if coding == "chunked" else uncoded(payload, coding)
        if undone is None:
            return "", coding
        payload = undone
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace"), None
    header = next((m[1] for k, v in http if k.lower() == "content-type" and (m := _HEADER_CHARSET.search(v))), None)
    name = _charset(header) if header else None
    if name is None and (m := _META_CHARSET.search(payload, 0, 4096)):
        name = _charset(m[1].decode("ascii"))
        name = "utf-8" if name and name.startswith("utf-16") else name  # it was read as ASCII
    if name is None:
        try:
            return payload.decode(), None
        except UnicodeDecodeError:
            name = "cp1252"
    return payload.decode(name, "replace"), None


def derive(source: Record, date: str) -> tuple[Record, Record]:
    """(metadata, conversion) of a response."""
    status, http, payload = http_parts(source.block)
    html, undone = decoded(payload, http)
    page = read(html)
    rid, url = source.get("WARC-Record-ID") or "", source.get("WARC-Target-URI")
    link = [("WARC-Target-URI", url), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", source.get("WARC-Date"))]
    fields = [("title", page.title), ("http-status", status)] + [(f"source-{k}".lower(), v) for k, v in http]
    fields += [("undecoded", undone), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block)), ("source-payload-digest", source.get("WARC-Payload-Digest") or digest(payload))]
    for href in page.links:
        try:
            fields.append(("outlink", f"{urljoin(url or '', href.strip())} L a/@href"))
        except ValueError:  # not a URL
            fields.append(("outlink", f"{href} L a/@href"))
    text = plain_text(page).encode()
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v).encode()
    return (
        record("metadata", record_id("metadata", rid), date, "application/warc-fields", about, link),
        record("conversion", record_id("conversion", rid), date, "text/plain; charset=utf-8", text, link),
    )


RESULT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("content_length", T.LongType()),
    T.StructField("block_digest", T.StringType()), T.StructField("source_payload_digest", T.StringType()), T.StructField("record", T.BinaryType()),
])


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col and the bytes of each page's response record."""
    pages = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("binary").alias("html"))
    schema = T.StructType([pages.schema[0], T.StructField("record", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [response(u, h or b"", date, f"{k}\n{u}").to_bytes() for k, u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=arrow)

    return pages.mapInArrow(run, schema)


def derivatives(records: DataFrame, date: str, keep: str, record_col: str = "record") -> DataFrame:
    """`keep` and RESULT: the metadata and conversion record of each response in records; other records give nothing."""
    records = records.select(F.col(f"`{keep}`"), F.col(f"`{record_col}`").cast("binary"))
    schema = T.StructType([records.schema[0], *RESULT])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for k, data in zip(batch.column(0).slice(i, 200).to_pylist(), batch.column(1).slice(i, 200).to_pylist()):
                    for source in parse(data or b""):
                        if source.get("WARC-Type") != "response":
                            continue
                        payload = source.get("WARC-Payload-Digest") or digest(http_parts(source.block)[2])
                        for r in derive(source, date):
                            rows.append((k, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), r.get("Content-Type"), len(r.block), r.get("WARC-Block-Digest"), payload, r.to_bytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return records.mapInArrow(run, schema)


#: What stands between records, and the first bytes of the next.
_BETWEEN = b"\r\n\r\nWARC/1."


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, record (bytes), fault of every record of the WARC files at path, gzip or plain.

    Records are read one after another and never a file at once; plain files are split between tasks. A block that holds
    what looks like a record's start is put together again by its length. A record that is cut off or has no valid length
    gives a row with its fault and no record, so that faults can be counted; a damaged gzip file ends at the damage, give or
    take the reader's buffer of 64 kB, and Spark's log names it.
    """
    reader = spark.read.option("lineSep", _BETWEEN.decode()).option("ignoreCorruptFiles", "true")
    pieces = reader.text(path).select("_metadata.file_path", F.col("value").cast("binary"))

    def size(piece: bytes) -> int | None:
        end = piece.find(b"\r\n\r\n")
        m = _LENGTH.search(piece, 0, end + 2) if end >= 0 else None
        return end + 4 + int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, have, need = None, [], 0, None

        def given() -> pa.RecordBatch:
            faults: list[str] = []
            found = [r.to_bytes() for r in parse(b"".join(parts), faults)] if any(p.strip() for p in parts) else []
            if not found and not faults and any(p.strip() for p in parts):
                faults = ["no record"]
            return pa.RecordBatch.from_arrays([pa.array([name] * (len(found) + len(faults)), pa.string()), pa.array(found + [None] * len(faults), pa.binary()), pa.array([None] * len(found) + faults, pa.string())], names=["path", "record", "fault"])

        for batch in batches:
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file == name and need is not None and have + len(b"\r\n\r\n") <= need:
                    parts.append(_BETWEEN + piece)  # the block goes on
                    have += len(parts[-1])
                    continue
                if parts:
                    yield given()
                piece = piece if piece.startswith(b"WARC/") else _BETWEEN[4:] + piece
                name, parts, have, need = file, [piece], len(piece), size(piece)
        if parts:
            yield given()

    return pieces.mapInArrow(run, "path string, record binary, fault string")


def write_warc(records: DataFrame, path: str, record_col: str = "record") -> None:
    """Writes the records as gzip WARC files, one a partition. A record ends in two line ends; the writer adds the last."""
    body = F.expr(f"cast(substring(`{record_col}`, 1, octet_length(`{record_col}`) - 2) as string)")
    records.select(body.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
