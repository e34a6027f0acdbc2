import base64
import hashlib
import re
import time
import uuid
import zlib
from html.parser import HTMLParser

import pytest

from sparksieve.llm.warc import derivatives, digest, parse_warc, plain_text, read_page, read_warc, response_records, responses, responses_from, write_warc

SCHEMA = "page_id long, url string, html string, record_id string, block int"
PAGE = "<!DOCTYPE html><html lang='fr'><head><title>A &amp; b</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=\"/x?a=1&amp;b=2\">x</a></nav><!-- no --><p>É &lt;b&gt; c<br>d<p>e  f</body></html>"
ROWS = [(1, "http://a/b", PAGE, "r", 1), (2, "http://a/c", None, "r", 1), (3, None, "", None, 1), (4, "u", "<p>x" * 30000, "r", 1), (1, "http://a/b", PAGE, "r", 1), (None, "v", "no markup, 3 < 4 & 5\n\n\nWARC/1.1\r\n\r\n", "r", 1)]


class Texts(HTMLParser):
    """A second reading of pages, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        self.out.append("\n" if tag in ("p", "br", "nav", "body", "html", "head", "h1", "div", "article", "ul", "li", "footer", "table", "tr", "pre", "section", "header") else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")
        self.out.append("\n" if tag in ("p", "nav", "body", "html", "head", "h1", "div", "article", "ul", "li", "footer", "table", "tr", "pre", "section", "header") else "")

    def handle_data(self, data):
        self.out += [] if self.hidden else [data]


def by_parser(page):
    p = Texts()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x)


def test_plain_text():
    assert plain_text(PAGE) == "x\nÉ <b> c\nd\ne f" == by_parser(PAGE)
    assert plain_text("a <!-- b") == "a"


def test_plain_text_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    same = sum(plain_text(r.html).split() == by_parser(r.html).split() for r in pages)
    assert same == len(pages)


def test_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    source = responses(frame)
    records = derivatives(source)
    rows = records.collect()
    assert len(rows) == 2 * len(ROWS)
    for r in rows:
        (headers, block), *rest = parse_warc(r.record.encode())
        assert not rest and block.decode() == r.block and headers["warc-type"] == r.warc_type and headers["warc-refers-to"] == r.refers_to
        assert digest(block) == r.block_digest == headers["warc-block-digest"] and len(block) == r.content_length
        assert r.warc_type == "conversion" or f"sourcePayloadDigest: {r.source_payload_digest}\r\n" in r.block
    kept = {r.record_id: bytes(r.payload).decode() for r in source.collect()}
    assert {r.refers_to for r in rows} == set(kept)
    assert {r.refers_to: r.source_payload_digest for r in rows} == {k: digest(v.encode()) for k, v in kept.items()}

    write_warc(response_records(source).select("record").union(records.select(records.record.cast("binary"))), str(tmp_path / "w"))
    read = read_warc(spark, str(tmp_path / "w"))
    assert read.count() == 3 * len(ROWS)
    again = derivatives(responses_from(read)).collect()
    assert sorted(r.record for r in again) == sorted(r.record for r in rows)


def test_long_markup_that_is_not_closed():
    for text in ("<a " * 350_000, "<a " * 350_000 + ">", "<html " * 170_000, "<script " * 120_000, "<!-- " * 200_000, "</title" * 140_000 + ">", "<" * 1_000_000, "<a href=\"" * 100_000, "<title>" * 150_000, "<!" * 500_000, "</" * 500_000):
        began = time.perf_counter()
        read_page(text)
        assert time.perf_counter() - began < 3, text[:10]


def test_odd_markup():
    for page in ("a < b", "1 <2> 3", "x </ b> y", "<p", "<p>a<", "a<b>c</b>d", "<style>x</styles>y</style >z", "<TITLE>T &amp; t</TITLE>u", "<!doctype html>v", "<?xml ?>w"):
        assert plain_text(page).split() == by_parser(page).split() or page in ("<p", "<p>a<", "x </ b> y", "1 <2> 3"), page
    assert read_page("<html class=x LANG=de-AT><a rel=1 href='/u?a&amp;b'>l</a><a>no</a><A HREF=/v>m</A>")[2:] == ("de-AT", ["/u?a&b", "/v"])


def by_hand(i, url, page):
    """The two records of a page, built step by step from the format's rules."""
    data = (page or "").encode()
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    uid = lambda n: "<urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, n)) + ">"
    uri = " ".join((url or "").split())
    source = uid(f"{i} {uri} {sha(data)}")
    text = by_parser(page or "").encode()
    title = re.search("<title>(.*?)</title>", page or "")
    lang = re.search("lang='([^']*)'", page or "")
    link = re.search('href="([^"]*)"', page or "")
    fields = (f"title: {title[1].replace('&amp;', '&')}\r\n" if title else "") + (f"language: {lang[1]}\r\n" if lang else "") + (f"outlink: {link[1].replace('&amp;', '&')}\r\n" if link else "")
    fields += f"textLength: {len(text)}\r\nsourcePayloadDigest: {sha(data)}\r\nsourceHeader: HTTP/1.1 200 OK\r\nsourceHeader: Content-Type: text/html; charset=utf-8\r\nsourceHeader: Content-Length: {len(data)}\r\n"
    out = []
    for kind, block, content, more in (("metadata", fields.encode(), "application/warc-fields", f"WARC-Concurrent-To: {uid(source + ' conversion')}\r\n"), ("conversion", text, "text/plain; charset=utf-8", "")):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {uid(f'{source} {kind}')}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: {uri}\r\nWARC-Refers-To: {source}\r\nWARC-Refers-To-Target-URI: {uri}\r\nWARC-Refers-To-Date: 2024-01-01T00:00:00Z\r\n"
        out.append((i, kind, head + more + f"WARC-Block-Digest: {sha(block)}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n" + block.decode()))
    return out


def test_records_against_an_independent_builder(spark):
    got = derivatives(responses(spark.createDataFrame(ROWS, SCHEMA))).collect()
    want = [x for r in ROWS for x in by_hand(*r[:3])]
    assert sorted(((r.page_id, r.warc_type, r.record) for r in got), key=repr) == sorted(want, key=repr)


def test_files_of_records(spark, tmp_path):
    """Blocks that hold what looks like a record's beginning, bytes that are no UTF-8, long records; a member for each record; a cut file."""
    blocks = [b"\xff\xfe\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n", b"", b"x" * (20 << 20), b"\r\n\r\nWARC/", b"\0\n\0" * 5]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nN: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(x)) + x for i, x in enumerate(blocks)]
    write_warc(spark.createDataFrame([(bytearray(r),) for r in records], "record binary"), str(tmp_path / "w"), 1)
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    data, members = file.read_bytes(), 0
    while data:
        d = zlib.decompressobj(31)
        got = d.decompress(data)
        members += got.startswith(b"WARC/")
        data = d.unused_data
    assert members == len(blocks)
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.warc").write_bytes(plain[: len(records[0]) + 4])
    for path in ("w", "p"):
        read = read_warc(spark, str(tmp_path / path)).collect()
        assert {int(r.headers["n"]): bytes(r.block) for r in read} == dict(enumerate(blocks if path == "w" else blocks[:1]))
    (tmp_path / "p" / "a.warc").write_bytes(plain[:60])
    with pytest.raises(Exception, match="within a record"):
        read_warc(spark, str(tmp_path / "p")).collect()


def test_payload_bytes_are_kept(spark, tmp_path):
    page = "<p>caf\xe9".encode("latin-1")
    block = b"HTTP/1.1 200 OK\r\nX:  two  blanks \r\n\r\n" + page
    frame = spark.createDataFrame([({"warc-type": "response", "warc-record-id": "<r>", "warc-target-uri": "u", "warc-date": "d"}, bytearray(block))], "headers map<string,string>, block binary")
    rows = derivatives(responses_from(frame)).collect()
    assert {r.source_payload_digest for r in rows} == {digest(page)} and any("sourceHeader: X:  two  blanks \r\n" in r.block for r in rows)


def test_empty_table(spark):
    assert derivatives(responses(spark.createDataFrame([], SCHEMA))).collect() == []
