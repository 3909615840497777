"""WARC derivatives: from response records to linked metadata and conversion records.

Each response gets a ``conversion`` record (its plain text) and a ``metadata`` record
(fields about the response). Both name the response in WARC-Refers-To, keep its target
URI, date and source headers, and carry SHA-1 digests of their blocks; the metadata also
keeps the source's block and payload digests.

A task joins its records to files of at most ``FILE_BYTES`` (or one longer record), which
Spark's text sink writes, so commits are Spark's. Reading takes whole files and goes from
record to record by Content-Length, so nothing inside a block can be taken for a boundary; a
record whose length or digest does not agree raises.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, END = "WARC/1.1", "\r\n\r\n"
#: Bytes of a file; a task that reads holds some of them.
FILE_BYTES = 16 << 20
NAMESPACE = uuid.NAMESPACE_URL
# A head may lack its closing tag: it ends before the first thing that can't stand in one.
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)"
                    r"|<head\b[^>]*>(?:\s+|<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b.*?(?:</\1\s*>|\Z)"
                    r"|<(?:meta|link|base|basefont|bgsound)\b[^>]*>)*(?:</head\s*>)?"
                    r"|<(script|style|noscript|template)\b.*?(?:</\2\s*>|\Z)", re.S | re.I)
BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|blockquote|pre|hr|title|body|html)\b[^>]*>", re.I)
TAGS = re.compile(r"<[!/?]?[a-zA-Z][^>]*>|<[!?][^>]*>")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
LANG = re.compile(r"<html[^>]*\blang=[\"']?([\w-]+)", re.I)
LINKS = re.compile(r"<a\b[^>]*\bhref=[\"']?([^\"'\s>]+)", re.I)
RESPONSE = "id {kind}, record_id string, uri string, date string, http_header string, payload string"
RECORD = "id {kind}, type string, record_id string, refers_to string, uri string, record string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_name(*parts) -> str:
    """A record id that follows from its parts, so that a repeated task writes the same one."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """The visible text: blocks on lines of their own, entities resolved, blanks collapsed."""
    text = TAGS.sub("", BREAKS.sub("\n", HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(text).replace("\0", " ").split("\n"))
    return "\n".join(x for x in lines if x)


def _one_line(value: str) -> str:
    return " ".join(value.split())


def make_record(kind: str, record_id: str, refers_to: str, uri: str, date: str, source: list[tuple[str, str]],
                content_type: str, block: bytes) -> str:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri),
              ("WARC-Date", date), *source, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type),
              ("Content-Length", str(len(block)))]
    return f"{VERSION}\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields) + "\r\n" + block.decode()


def derive(record_id: str, uri: str, date: str, http_header: str, payload: str) -> list[tuple[str, str, str]]:
    """(type, record id, record) of the conversion and the metadata of one response."""
    body = payload.encode()
    source = [("WARC-Source-Block-Digest", digest(http_header.encode() + END.encode() + body)), ("WARC-Source-Payload-Digest", digest(body))]
    headers = [(f"X-Source-{k.strip()}", v.strip()) for k, _, v in (x.partition(":") for x in http_header.split("\r\n")[1:]) if v]
    text = plain_text(payload)
    conversion, meta = record_name(record_id, "conversion"), record_name(record_id, "metadata")
    title, lang = TITLE.search(payload), LANG.search(payload)
    fields = [("conversion", conversion), ("status", http_header.split("\r\n")[0]), *headers,
              ("title", html.unescape(TAGS.sub("", title[1])) if title else ""), ("language", lang[1] if lang else ""),
              ("text-digest", digest(text.encode())), ("text-bytes", str(len(text.encode()))),
              *[("outlink", html.unescape(x)) for x in dict.fromkeys(LINKS.findall(payload))]]
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)
    return [("conversion", conversion, make_record("conversion", conversion, record_id, uri, date, [*source, *headers], "text/plain; charset=utf-8", text.encode())),
            ("metadata", meta, make_record("metadata", meta, record_id, uri, date, source, "application/warc-fields", about.encode()))]


def _responses(date: str, header: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, uris, pages, rows = (b.column(c).to_pylist() for c in ("id", "uri", "payload", "row"))
            uris = [_one_line(u or "") for u in uris]
            names = [record_name(*x, "response") for x in zip(ids, uris, rows, strict=True)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(names), pa.array(uris), pa.array([date] * n), pa.array([header] * n), pa.array([p or "" for p in pages])],
                names=["id", "record_id", "uri", "date", "http_header", "payload"])

    return run


def responses(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z",
              header: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8") -> DataFrame:
    """Response records of stored pages. The table has no dates and headers, so these are
    parameters. Null addresses and pages count as empty. Record ids follow from the page's id,
    address and place in the table, so that equal rows have records of their own."""
    kind = pages.schema[id_col].dataType.simpleString()
    return (pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(html_col).alias("payload"), F.monotonically_increasing_id().alias("row"))
            .mapInArrow(_responses(date, header), RESPONSE.format(kind=kind)))


def _derive(batches):
    import pyarrow as pa

    from rarebird.llm.arrowbatch import text_chunks

    for chunk in text_chunks(batches, "payload"):
        cols = [[x or "" for x in chunk.column(c).to_pylist()] for c in ("record_id", "uri", "date", "http_header", "payload")]
        out = [(i, kind, name, r[0], r[1], record) for i, r in enumerate(zip(*cols, strict=True)) for kind, name, record in derive(*r)]
        rows, *rest = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([chunk.column("id").take(pa.array(rows)), *[pa.array(x, pa.string()) for x in rest]],
                                         names=["id", "type", "record_id", "refers_to", "uri", "record"])


def derivatives(response_records: DataFrame) -> DataFrame:
    """(id, type, record_id, refers_to, uri, record): two rows for each response. Nulls in the
    response's text columns count as empty; repeated responses give repeated records; an
    empty payload gives an empty conversion block. Other columns are not read."""
    kind = response_records.schema["id"].dataType.simpleString()
    return response_records.select("id", "record_id", "uri", "date", "http_header", "payload").mapInArrow(_derive, RECORD.format(kind=kind))


def _files(limit: int):
    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for b in batches:
            for record in b.column("record").to_pylist():
                length = len(record.encode()) + len(END)
                if held and size + length > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], names=["file"])
                    held, size = [], 0
                held.append(record)
                size += length
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], names=["file"])

    return run


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """WARC files of at most ``file_bytes`` each, or one longer record. No shuffle."""
    files = records.select("record").mapInArrow(_files(file_bytes), "file string")
    files.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def records_of(data: bytes):
    """(header fields, block) of each record of a file, by the lengths they state."""
    at, end = 0, END.encode()
    while at < len(data):
        to = data.find(end, at)
        lines = data[at:to].decode().split("\r\n")
        fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        length = dict(fields).get("Content-Length", "")
        start = to + len(end)
        if to < 0 or not lines[0].startswith("WARC/") or not length.isdecimal() or data[start + int(length):start + int(length) + len(end)] != end:
            raise ValueError(f"no WARC record at byte {at}")
        yield fields, data[start:start + int(length)]
        at = start + int(length) + len(end)


def _parse(batches):
    import pyarrow as pa

    kinds = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()),
                       ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("n_bytes", pa.int64()), ("block_digest", pa.string())])
    for b in batches:
        for data in b.column("content"):
            out = []
            for fields, block in records_of(data.as_py()):
                got = dict(fields)
                if "WARC-Block-Digest" in got and digest(block) != got["WARC-Block-Digest"]:
                    raise ValueError(f"damaged record {got.get('WARC-Record-ID')}")
                out.append((*[got.get(k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date")],
                            list(got.items()), block, len(block), got.get("WARC-Block-Digest")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under ``path``, every length and digest checked. Of a header that
    repeats, the last counts in ``headers``; headers that a record lacks are null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, "type string, record_id string, refers_to string, uri string, date string, "
                                    "headers map<string,string>, block binary, n_bytes long, block_digest string")
