"""WARC derivatives: metadata and plain-text conversion records for response records.

Both derivatives name their response in WARC-Refers-To and keep its target, date and digests; the metadata record holds the
source's headers as JSON, as lists of names and values since names repeat, with links, the conversion record holds the visible text,
read from the same tree that the layout operator builds, a line for each block.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import BATCH_BYTES, batches_by_bytes
from framewright.llm.html_layout import attributes, elements, parse, plain_lines

VERSION = b"WARC/1.1"
#: The namespace of record ids that are derived from other ids.
NAMESPACE = uuid.UUID("5f0c1f2e-6f3a-5b8c-9d2e-0a7b1c4d3e6f")
#: Two base-32 digits for each ten bits.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
TEN_BITS = [a + b for a in DIGITS for b in DIGITS]


def sha1(data: bytes) -> str:
    """A digest as archives write it, in base 32."""
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([TEN_BITS[n >> shift & 1023] for shift in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    """An id that depends on ``parts`` alone, so reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record; the block's digest and length are added."""
    lines = [*headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the fields, continued lines joined."""
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return first, out


def split_head(data: bytes) -> tuple[bytes, bytes]:
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (i := data.find(mark)) >= 0:
            return data[:i], data[i + len(mark) :]
    return data, b""


def one(fields: list[tuple[str, str]], name: str) -> str | None:
    """The first field of a name, in any case."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def by_name(fields: list[tuple[str, str]]) -> dict[str, str]:
    """The first field of each name, names in lower case."""
    return {k.lower(): v for k, v in reversed(fields)}


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Fields and block of one record; ValueError if it isn't one or is cut short."""
    head, rest = split_head(data)
    first, fields = parse_headers(head)
    length = one(fields, "Content-Length")
    if not first.startswith("WARC/") or length is None or not (length.isascii() and length.isdigit()):
        raise ValueError("not a WARC record")
    if len(rest) < int(length):
        raise ValueError("the record is cut short")
    return fields, rest[: int(length)]


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of a file, plain or gzipped by record, one at a time; raises where the file is damaged."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC file")
        head = [line]
        while (line := stream.readline()) and line.strip():
            head.append(line)
        length = one(parse_headers(b"".join(head))[1], "Content-Length") or ""
        if not (length.isascii() and length.isdigit()):
            raise ValueError("a record without length")
        left, block = int(length), []
        while left and (piece := stream.read(min(left, BATCH_BYTES))):  # what is stated may be far more than there is
            block.append(piece)
            left -= len(piece)
        if left:
            raise ValueError("the file is cut short")
        yield b"".join([*head, b"\r\n", *block, b"\r\n\r\n"])


def inflate(body: bytes) -> bytes:
    """What a deflated body holds, with or without the wrapper that the standard asks for."""
    try:
        return zlib.decompress(body)
    except zlib.error:
        return zlib.decompress(body, -zlib.MAX_WBITS)


def decode_body(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The entity of a response: chunks joined, then gzip or deflate undone; a damaged one, or one of another coding, stays as it is."""
    raw = body
    try:
        if (one(fields, "Transfer-Encoding") or "").lower() == "chunked":
            out, at = [], 0
            while True:
                end = body.index(b"\r\n", at)
                n = int(body[at:end].split(b";")[0], 16)
                if not n:
                    break
                if n < 0:
                    raise ValueError("a chunk of less than nothing")
                out.append(body[end + 2 : end + 2 + n])
                at = end + n + 4
            body = b"".join(out)
        coding = (one(fields, "Content-Encoding") or "").lower()
        return gzip.decompress(body) if coding in ("gzip", "x-gzip") else inflate(body) if coding == "deflate" else body
    except (ValueError, OSError, EOFError, zlib.error):
        return raw


CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


#: Codecs of Python that are no charsets of texts.
NO_CHARSETS = frozenset(["idna", "punycode", "raw_unicode_escape", "undefined", "unicode_escape", "raw-unicode-escape", "unicode-escape", "mbcs", "oem"])


def decoded(entity: bytes, code: str) -> str:
    """The text of an entity by its stated charset; UTF-8 if that is unknown, no charset of texts or can't be used. Halves of surrogate pairs
    that some charsets give become question marks."""
    try:
        if codecs.lookup(code).name in NO_CHARSETS:
            raise LookupError(code)
        text = entity.decode(code, "replace")
    except Exception:  # codecs raise what they like
        text = entity.decode("utf-8", "replace")
    return clean(text)


def clean(text: str) -> str:
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode("utf-8")
    return text


#: What a page starts with, and what shows one wherever it stands.
PAGE = re.compile(
    r"(?:\s|<!--.*?-->|<\?.*?\?>)*+<(?:!doctype\s+html|(?:html|head|body|title|meta|link|base|script|style|iframe|h[1-6]|div|span|font|table|ul|ol|a|b|i|br|p|img|form|center|main|section|article|header|nav)(?=[\s/>]))",
    re.I | re.S,
)
INNER = re.compile(r"<(?:!doctype\s+html|(?:html|head|body)(?=[\s/>]))", re.I)
BINARY = re.compile(rb"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def sniff(body: bytes) -> tuple[str, str]:
    """Type and charset of a payload without a stated type, from all its bytes; an empty type if they aren't text."""
    code = next((c for mark, c in MARKS if body.startswith(mark)), "utf-8")
    if code != "utf-16" and BINARY.search(body):
        return "", code
    text = body.decode(code, "replace")
    return "text/html" if PAGE.match(text) or INNER.search(text) else "text/plain", code


def judged(stated: str | None, data: bytes) -> bool | None:
    """Whether a stated digest is that of ``data``: in base 32 or hexadecimal, by any algorithm known here; None if that can't be told."""
    name, mark, value = (stated or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if not mark or name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    digest = hashlib.new(name, data).digest()
    return value.lower() == digest.hex() if len(value) == 2 * len(digest) else value.upper() == base64.b32encode(digest).decode().rstrip("=") if len(value) == -(-8 * len(digest) // 5) else None


def digests_hold(stated: list[tuple[str | None, bytes]]) -> bool | None:
    """False if a stated digest is wrong; None if none can be judged though some are stated; else true."""
    found = [judged(s, data) for s, data in stated if s]
    return False if False in found else True if True in found or not found else None


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """Visible text, title and targets of links (in order, repeats kept) of a page."""
    tree = parse(page)
    title, links = None, []
    for node in elements(tree):
        if node.tag == "title" and title is None:
            title = " ".join("".join(x for x in node.children if isinstance(x, str)).split())
        elif node.tag in ("a", "area", "link") and (href := attributes(node.attrs).get("href")) is not None:
            links.append(href)
    return plain_lines(tree), title, links


def derive(data: bytes | None) -> dict:
    """The derivatives of one response record and what the table shows of them; ``error`` says why there are none."""
    try:
        if data is None:
            raise ValueError("no record")
        fields, block = parse_record(data)
        warc = by_name(fields)
        if warc.get("warc-type") != "response":
            raise ValueError(f"a {warc.get('warc-type')} record has no derivatives")
    except ValueError as e:
        return {"error": str(e)}
    head, body = split_head(block)
    status, http = parse_headers(head)
    kind = (by_name(http).get("content-type") or "").lower()
    source, target, date = (warc.get(k) or "" for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    payload, stated, whole = sha1(body), warc.get("warc-payload-digest"), warc.get("warc-block-digest")
    hold = digests_hold([(stated, body), (whole, block)])
    entity, stated_code = decode_body(http, body), CHARSET.search(one(http, "Content-Type") or "")
    code = stated_code[1] if stated_code else "utf-8"
    if not kind:
        kind, code = sniff(entity)
    page = decoded(entity, code)
    text, title, links = read_page(page) if "html" in kind else (page if kind.startswith("text/") else "", None, [])
    shared = [("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]
    text = clean(text)  # character references can name surrogates
    about = {"warc": fields, "status": status, "http": http, "title": title, "links": links}
    meta_id, text_id = record_id(source, "metadata"), record_id(source, "conversion")
    block_m, block_t = json.dumps(about, ensure_ascii=False).encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    meta = write_record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *shared, ("WARC-Source-Payload-Digest", stated or payload), ("Content-Type", "application/json")], block_m)
    conversion = write_record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *shared, ("WARC-Source-Payload-Digest", stated or payload), ("Content-Type", "text/plain; charset=utf-8")], block_t)
    return {
        "refers_to": source, "target_uri": target, "warc_date": date, "http_status": status, "payload_digest": payload, "digest_ok": hold,
        "metadata_id": meta_id, "conversion_id": text_id, "n_links": len(links), "text": text, "metadata": meta, "conversion": conversion, "error": None,
    }


FIELDS = [("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("http_status", pa.string()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("metadata_id", pa.string()), ("conversion_id", pa.string()), ("n_links", pa.int32()), ("text", pa.string()), ("metadata", pa.binary()), ("conversion", pa.binary()), ("error", pa.string())]
DDL = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int", pa.binary(): "binary"}


def _each_binary(df: DataFrame, column: str, fields: list, work) -> DataFrame:
    """``df`` without ``column``, with the fields of ``work(value)``."""
    kept = [c for c in df.columns if c != column and c not in {n for n, _ in fields}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, len(kept)):
            rows = [work(v) for v in part.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array([r.get(n) for r in rows], t) for n, t in fields)], [*kept, *(n for n, _ in fields)])

    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {DDL[t]}" for n, t in fields])
    return df.select(*kept, column).mapInArrow(run, ddl)


def derivatives(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` without ``column`` (binary response records), with both derivative records and their fields.

    A null, damaged or other kind of record keeps its row, with nulls and the reason in ``error``. ``digest_ok`` is null where digests are stated that
    can't be judged. Repeated records give equal
    derivatives, ids included; records of any length are derived whole; an empty table gives an empty table. Other columns are kept unless they are named like an output.
    """
    return _each_binary(records, column, FIELDS, derive)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, record, error`` of the WARC files below ``path``, plain or gzipped.

    Records leave a task as they are read. A damaged file gives what comes before the damage and then a row without record that says
    why in ``error``; an empty file gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(name: str, part: list[bytes | None], error: str | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.binary()), pa.array([error] * len(part), pa.string())], ["path", "record", "error"])

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, used = [], 0
                try:
                    for record in read_records(data.as_py()):
                        part.append(record)
                        used += len(record)
                        if used >= BATCH_BYTES:
                            yield rows(name, part)
                            part, used = [], 0
                    yield rows(name, part)
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    yield rows(name, part)
                    yield rows(name, [None], str(e))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, record binary, error string")


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``page_id, record``: a response record for each row of ``pages(page_id, url, html)``, with ids and digests that depend on
    the row alone. A null page has an empty payload, a null address an empty target; repeated rows give equal records; a page of any
    length is one record; other columns are left out."""

    def build(page_id: str | None, url: str | None, html: str | None) -> bytes:
        body, url = (html or "").encode("utf-8", "surrogatepass"), url or ""
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        ident = record_id(str(page_id), url, hashlib.sha1(body).hexdigest())
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", ident), ("WARC-Target-URI", re.sub(r"[\r\n]+", "", url)), ("WARC-Date", date), ("WARC-Payload-Digest", sha1(body)), ("Content-Type", "application/http; msgtype=response")]
        return write_record(headers, http + body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, 3):
            records = map(build, *(c.to_pylist() for c in part.columns[1:]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(records), pa.binary())], ["page_id", "record"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("page_id").cast("string").alias("name"), "url", "html").mapInArrow(run, f"page_id {kind}, record binary")


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Both derivatives of every row of ``pages``: ids, source headers, digests, text and record digests."""
    out = derivatives(response_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    names = ["refers_to", "target_uri", "warc_date", "http_status", "payload_digest", "digest_ok", "metadata_id", "conversion_id", "n_links", "text"]
    return out.select("page_id", *names, F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"), "error")
