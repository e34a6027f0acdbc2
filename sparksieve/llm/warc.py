r"""WARC derivatives: from responses, linked metadata and plain-text conversion records.

responses() builds WARC/1.1 response records of fetched pages; read_warc() takes them from files instead.
derivatives() turns each response into

* a `metadata` record (application/warc-fields: title, language, counts and outlinks of the page), and
* a `conversion` record (the page's plain text),

each with `WARC-Refers-To` (the response's record id), `WARC-Refers-To-Target-URI`, `WARC-Refers-To-Date`
and `WARC-Target-URI` as the response has them; the metadata also names the conversion (`WARC-Concurrent-To`).
The response's HTTP header lines and its payload digest go into the metadata unchanged, so the source can be
checked.  Record ids are name-based UUIDs of the response's id and the record's type: reruns agree.

write_warc() writes records through Spark's text sink, a gzip member each, and read_warc() reads files as streams
through Spark's text source, from and to any store that Spark knows.  Pages are read in one pass, in time
proportional to their length whatever their markup.

Cases: null html is an empty payload, null url an empty target; a page of markup only has an empty text;
repeated pages give equal records again; text that isn't closed markup is read to the end; bytes that are no UTF-8
stay as they are in payloads and digests, and are replacement characters in texts; a response without a digest
gets one; extra columns are left out; no rows give no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a record in a gzip member (under 16 MB, see write_warc()).
MEMBER = 8 << 20

# Record names of WARC/1.1.
VERSION = "WARC/1.1"
FIELDS = "application/warc-fields"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs in RFC 9562

RESPONSES = "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload_digest string, payload binary"
RECORDS = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, source_http_headers string, record string, block string"
)

# Elements whose content isn't text of the page, and elements that end a line.  A pattern that looks for a > is used on text that ends with one
# only, so each place where it begins to match is taken whole, and time is proportional to the text.
_HIDDEN = re.compile(r"<!--.*?(-->|\Z)|<(script|style|noscript|template|textarea|svg|title)\b[^>]*>(.*?)(</\2\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|article|section|header|footer|nav|aside|main|blockquote|pre|form|figure|figcaption|address|body|head|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z]|[!?])[^>]*>")
_OPEN = re.compile(r"<(a|html)\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"\b(lang|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_LANG = re.compile(r"[A-Za-z0-9-]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, name)}>"


class Page(NamedTuple):
    text: str
    title: str | None
    language: str | None
    links: list[str]


def _attribute(tag: str, name: str) -> str | None:
    """The first value of an attribute in a tag's text."""
    for m in _ATTRIBUTE.finditer(tag):
        if m[1].lower() == name:
            return m[2] or m[3] or m[4] or ""
    return None


def _closed(text: str) -> int:
    return text.rfind(">") + 1


def read_page(page: str) -> Page:
    """Hidden elements out, block elements as line ends, entities resolved, blanks collapsed; title, language and outlinks of what is shown."""
    end = _closed(page)
    parts, title, at, rest = [], None, 0, page[end:]
    for m in _HIDDEN.finditer(page[:end]):
        parts += [page[at : m.start()], " "]
        at = m.end()
        if title is None and m[2] and m[2].lower() == "title":
            title = one_line(html.unescape(m[3]))
        if not (m[4] if m[2] else m[1]):  # not closed: hidden to the page's end
            rest = ""
    comment = rest.find("<!--")
    shown = "".join([*parts, page[at:end], rest if comment < 0 else rest[:comment]])
    end = _closed(shown)
    language, links = None, []
    for m in _OPEN.finditer(shown[:end]):
        if len(m[1]) == 1:
            link = _attribute(m[0], "href")
            links += [] if link is None else [one_line(html.unescape(link))]
        elif language is None:
            found = _LANG.match(_attribute(m[0], "lang") or "")
            language = found[0] if found else None
    for pattern, to in ((_BREAK, "\n"), (_TAG, "")):
        end = _closed(shown)
        shown = pattern.sub(to, shown[:end]) + shown[end:]
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(shown).split("\n"))
    return Page("\n".join(line for line in lines if line), title, language, links)


def plain_text(page: str) -> str:
    return read_page(page).text


def one_line(text: str) -> str:
    return " ".join(text.split())


def page_fields(page: Page) -> list[tuple[str, str]]:
    found = [("title", page.title)] if page.title is not None else []
    found += [("language", page.language)] if page.language else []
    return found + [("outlink", x) for x in page.links]


def serialized(headers: list[tuple[str, str]], block: bytes) -> str:
    """A record without the two line ends that close it."""
    return f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n" + block.decode("utf-8", "surrogateescape")


def http_headers(size: int) -> str:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages(page_id, url, html) -> response records (RESPONSES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, url, page in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                page, uri = page or "", one_line(url or "")
                data = page.encode()
                rows.append((i, record_id(f"{i} {uri} {digest(data)}"), uri, date, http_headers(len(data)), digest(data), data))
            yield _batch(rows, RESPONSES)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RESPONSES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.strip().split(" ") for x in schema.split(",")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, (_, t) in zip(columns, named, strict=True)], [k for k, _ in named])


def derive(row: tuple) -> list[tuple]:
    """The metadata and the conversion of one response."""
    page, source, uri, date, http, payload_digest, payload = row
    read = read_page(payload.decode("utf-8", "replace"))
    text = read.text.encode()
    ids = {kind: record_id(f"{source} {kind}") for kind in ("metadata", "conversion")}
    fields = [*page_fields(read), ("textLength", str(len(text))), ("sourcePayloadDigest", payload_digest or digest(payload)), *(("sourceHeader", h) for h in http.split("\r\n") if h)]
    blocks = {"metadata": (FIELDS, "".join(f"{k}: {v}\r\n" for k, v in fields).encode(), [("WARC-Concurrent-To", ids["conversion"])]), "conversion": ("text/plain; charset=utf-8", text, [])}
    out = []
    for kind, (content, block, more) in blocks.items():
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            *more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block))),
        ]
        out.append((page, kind, ids[kind], source, uri, date, content, len(block), digest(block), payload_digest, http, serialized(headers, block), block.decode()))
    return out


def derivatives(found: DataFrame) -> DataFrame:
    """Response records -> metadata and conversion records (RECORDS)."""
    names = [x.strip().split(" ")[0] for x in RESPONSES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                rows = zip(*(c.to_pylist() for c in b.slice(i, 1000).columns), strict=True)
                yield _batch([x for row in rows for x in derive(row)], RECORDS)

    return found.select(*names).mapInArrow(run, RECORDS)


def write_warc(records: DataFrame, path: str, files: int | None = None) -> None:
    """Writes the column `record` (string or binary) as .warc.gz files with a gzip member for each record.

    Spark's text sink ends each row with a line separator of one zero byte, which is the last byte of a member of
    under 16 MB (its size, low byte first); a longer record is several members.  Files get their names at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for record in b.column(0):
                data = record.as_buffer().to_pybytes() + b"\r\n\r\n"
                members = b"".join(gzip.compress(data[i : i + MEMBER], 6, mtime=0) for i in range(0, len(data), MEMBER))
                yield pa.RecordBatch.from_arrays([pa.array([members[:-1]], pa.binary())], ["value"])

    out = records.select(F.col("record").cast("binary").alias("record"))
    out = out.repartition(files) if files else out
    out.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    jvm, spark = records.sparkSession._jvm, records.sparkSession
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            store.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        headers, start = parse_headers(data, at)
        size = int(headers["content-length"])
        yield headers, data[start : start + size]
        at = start + size + 4


def parse_headers(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Headers by lower-case name, and where the block begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


_BETWEEN = b"\r\n\r\nWARC/"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block binary) of all records of the WARC files at `path`, plain or gzip, of any size.

    Spark's text source reads files as streams, cut where a record may begin; a piece that is shorter than its record
    says is joined to the next ones of its file.  So a task holds a record at a time.  A file that is cut within a
    record is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.map_(pa.string(), pa.string()), pa.binary()]
        of, held, headers, start, need = None, [], {}, 0, 0
        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                piece = value.as_buffer().to_pybytes()
                if held and file != of:
                    raise ValueError(f"{of} ends within a record")
                if held:
                    held.append(_BETWEEN + piece)
                else:
                    of, held = file, [piece if piece.startswith(b"WARC/") else b"WARC/" + piece]
                    headers, start = parse_headers(held[0])
                    need = start + int(headers["content-length"])
                if sum(map(len, held)) >= need:
                    yield pa.RecordBatch.from_arrays([pa.array([[*headers.items()]], kinds[0]), pa.array([b"".join(held)[start:need]], kinds[1])], ["headers", "block"])
                    held = []
        if held:
            raise ValueError(f"{of} ends within a record")

    pieces = spark.read.option("lineSep", _BETWEEN.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(run, "headers map<string,string>, block binary")


def response_records(responses_table: DataFrame) -> DataFrame:
    """Adds `record`, the serialized response, for write_warc()."""
    block = F.concat(F.col("http_headers").cast("binary"), F.col("payload"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\n"), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Payload-Digest", F.col("payload_digest")), F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return responses_table.withColumn("record", F.concat(head.cast("binary"), block))


def responses_from(read: DataFrame) -> DataFrame:
    """Response records (RESPONSES) from read_warc(), their payloads' bytes as they are; page_id is null, as WARC has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pairs, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, data = dict(pairs), block.as_buffer().to_pybytes()
                at = data.find(b"\r\n\r\n") + 4
                at = at if at > 3 else 0
                rows.append((None, h.get("warc-record-id"), h.get("warc-target-uri", ""), h.get("warc-date", ""), data[:at].decode("latin-1"), h.get("warc-payload-digest") or digest(data[at:]), data[at:]))
            yield _batch(rows, RESPONSES)

    return read.filter(F.element_at("headers", "warc-type") == "response").select("headers", "block").mapInArrow(run, RESPONSES)
