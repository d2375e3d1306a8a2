import gzip
import html
import re
import zlib

from corpusloom.llm import warc
from corpusloom.llm.html_dom import blocks, parse


def test_records_link_and_verify(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 2 * len(source)
    ids = {r.record_id: r for r in rows}
    for r in rows:
        headers, block = warc.parse_record(r.record)
        h = dict(headers)
        response = source[r.refers_to]
        assert h["WARC-Refers-To"] == r.refers_to and h["WARC-Target-URI"] == response.target_uri
        assert h["WARC-Source-Block-Digest"] == warc.digest(bytes(response.block)) and h["WARC-Block-Digest"] == warc.digest(block)
        assert ids[r.concurrent_to].concurrent_to == r.record_id and block.decode() == r.block
        if r.warc_type == "metadata":
            assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
            assert r.block.count("outlink: ") == len(re.findall(r"<a href", bytes(response.block).decode()))
        else:
            assert "<" not in re.sub(r"&", "", r.block) and "track(" not in r.block


def test_edge_rows(spark):
    cases = [
        ("<a>", "u", "d", b"HTTP/1.1 404 Not Found\r\nX-A: 1\r\n two\r\nX-A: 3\r\n\r\n<p>caf\xc3\xa9 &amp; x<br>y<script>no</script>"),
        ("<b>", None, None, None),
        ("<c>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<title>\xe9</title><p>\xe9"),
        ("<c>", "u", "d", b"no header at all"),
    ]
    df = spark.createDataFrame(cases, "record_id string, target_uri string, warc_date string, block binary").selectExpr("*", "1 AS warc_type")
    rows = warc.derivatives(df, keep=None).collect()
    by = [(r.refers_to, r.warc_type, r.block) for r in rows]
    assert ("<a>", "conversion", "café & x y") in by and ("<b>", "conversion", "") in by and ("<c>", "conversion", "é") in by and ("<c>", "conversion", "no header at all") in by
    meta = next(b for i, t, b in by if i == "<a>" and t == "metadata")
    assert "http-status: HTTP/1.1 404 Not Found\r\nhttp-header: X-A: 1 two\r\nhttp-header: X-A: 3\r\n" in meta
    assert warc.derivatives(df.limit(0), keep=None).count() == 0


def test_parser_repairs():
    text = lambda h: blocks(parse(h), lambda n: n.tag == "script")
    assert text("<p>a<p>b</b></i>c<ul><li>d<li>e</ul>f") == ["a", "bc", "d", "e", "f"]
    assert text("x<!-- <p> -->y<script>var t='</p>';</script>z") == ["xyz"]
    assert text('<div title="a>b">t</div><') == ["t", "<"]
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert text("&lt;b&gt; &#233;&nbsp;&amp;amp;") == ["<b> é &amp;"]
    assert text("<div>" * 5000 + "deep") == ["deep"]
    assert text("") == [] and text("<script>never closed") == []


def test_conversion_text_of_the_whole_query(spark, sf):
    """Against a plain version: tags out, blocks at block tags, white space tidied."""
    from corpusloom.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = [r for r in QUERIES["op1_warc_derivatives"](spark, sf).collect() if r.warc_type == "conversion"]
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        body = re.sub(r"<!--.*?-->|<(head|script|style)\b.*?</\1>|<!DOCTYPE[^>]*>", "", pages[r.page_id], flags=re.S | re.I)
        parts = re.split(r"</?(?:p|h1|div|li|ul|nav|article|footer|body|html|header|aside|section|main|table|tr|td|form)\b[^>]*>", body)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
        assert " ".join(r.block.split()) == " ".join(x for x in want if x)


def test_codings_and_odd_charsets(spark):
    page = "<p>caf\u00e9".encode()
    chunked = b"5\r\n" + page[:5] + b"\r\n" + hex(len(page) - 5)[2:].encode() + b";x=y\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    bodies = [
        (b"Content-Encoding: gzip", gzip.compress(page)), (b"Content-Encoding: deflate", zlib.compress(page)), (b"Transfer-Encoding: chunked", chunked),
        (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", b"%x\r\n" % len(gzip.compress(page, mtime=0)) + gzip.compress(page, mtime=0) + b"\r\n0\r\n\r\n"),
        *((b"Content-Type: text/html; charset=" + c, page) for c in (b"idna", b"undefined", b"hex", b"nonsense", b"utf-8")), (b"Content-Encoding: br", page),
    ]
    for head, body in bodies:
        meta, conversion = warc.derive("<x>", "u", "d", b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)
        assert conversion["block"] == "caf\u00e9", head
    assert warc.plain_body([("Content-Encoding", "gzip")], b"not gzip") == b"not gzip"


def test_source_records_are_read_and_carried_over(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title>t</title><p>x"
    right = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-IP-Address", "192.0.2.1"), ("WARC-Block-Digest", warc.digest(block)), ("WARC-Payload-Digest", "md5:0f")]
    wrong = [*right[:1], ("WARC-Record-ID", "<urn:uuid:2>"), *right[2:5], ("WARC-Block-Digest", warc.digest(b"else"))]
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x")
    plain = info + warc.record(right, block) + warc.record(wrong, block)
    zipped = b"".join(map(gzip.compress, (info, warc.record(right, block)))) + b"\x1f\x8bbroken"
    files = spark.createDataFrame([(plain, 1), (zipped, 2), (None, 3), (b"", 4), (b"no record", 5)], "content binary, record_id int")
    rows = warc.response_rows(files)
    assert sorted(r.record_id for r in rows.collect()) == ["<urn:uuid:1>", "<urn:uuid:1>", "<urn:uuid:2>"]
    made = {(r.refers_to, r.warc_type): r for r in warc.derivatives(rows, keep=None).collect()}
    meta = made["<urn:uuid:1>", "metadata"]
    assert "warc-header: WARC-IP-Address: 192.0.2.1\r\n" in meta.block and "digest-mismatch" not in meta.block
    assert meta.source_payload_digest == "md5:0f" and meta.source_block_digest == warc.digest(block) and made["<urn:uuid:1>", "conversion"].source_payload_digest == "md5:0f"
    assert f"digest-mismatch: block {warc.digest(block)}\r\n" in made["<urn:uuid:2>", "metadata"].block
    assert warc.response_rows(files.limit(0)).count() == 0
