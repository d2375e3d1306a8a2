"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A *response* is a row with its record id, target URI, date and block (the HTTP
message as bytes).  Each gives two records:

* ``metadata`` (``application/warc-fields``): status, every header of the source's
  HTTP message in order (``http-header: name: value``), charset, title, outlinks;
* ``conversion`` (``text/plain``): the visible text, a block a line.

Both carry ``WARC-Refers-To`` with the response's id, its target URI and date,
``WARC-Concurrent-To`` with each other's id, the response's digests under
``WARC-Source-*``, and digests of their own blocks.  Ids are derived from the
response's id by hashing, so a retried task writes the same records again.
Rows are independent; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require
from corpusloom.llm.html_dom import Node, blocks, parse, tidy
from corpusloom.llm.text_arrays import chunks

VERSION, NO_DATE = "WARC/1.1", "1970-01-01T00:00:00Z"
_INVISIBLE = frozenset("script style noscript template iframe head title textarea".split())
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)


def digest(data: bytes) -> str:
    """A labelled digest: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    """A record id that depends on the parts alone."""
    h = hashlib.sha1("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A serialised WARC record; line breaks in header values become spaces."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join([VERSION, *lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a serialised record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = [tuple(x.split(": ", 1)) for x in head.decode().split("\r\n")[1:]]
    size = int(dict(headers)["Content-Length"])
    return headers, rest[:size]


def http_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and body; a block without a header part is all body."""
    head, cut, body = block.partition(b"\r\n\r\n")
    if not cut:
        head, cut, body = block.partition(b"\n\n")
    if not cut or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").splitlines()
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return status, headers, body


def plain_body(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """A body without its transfer and content codings (chunked, gzip, deflate), as far as it can be read; others stay as they are."""
    about = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in about.get("transfer-encoding", ""):
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0 and re.fullmatch(rb"[0-9a-fA-F]+", size := body[at:end].split(b";")[0].strip()):
            n = int(size, 16)
            parts.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
            if not n:
                break
        body = b"".join(parts) if at else body
    for coding in reversed(about.get("content-encoding", "").replace(" ", "").split(",")):
        for wbits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            reader = zlib.decompressobj(wbits)
            try:
                body = reader.decompress(body)
            except zlib.error:
                continue
            break
    return body


def decoded(headers: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """Charset and text of a body: from the headers, else from the page's beginning, else UTF-8; names that are no text encoding count as UTF-8."""
    body = plain_body(headers, body)
    stated = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = _CHARSET.search(stated) or _CHARSET.search(body[:1024].decode("latin-1"))
    charset = found[1].lower() if found else "utf-8"
    try:
        return charset, body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return "utf-8", body.decode("utf-8", "replace")


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file, plain or gzipped by record; ends at the first thing that is no record."""
    if data[:2] == b"\x1f\x8b":
        while data[:2] == b"\x1f\x8b":
            reader = zlib.decompressobj(31)
            try:
                member = reader.decompress(data)
            except zlib.error:
                return
            yield from parse_records(member)
            data = reader.unused_data
        return
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = [(k.strip(), v.strip()) for k, cut, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]) if cut]
        stated = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not stated.isdigit():
            return
        yield headers, data[end + 4 : end + 4 + int(stated)]
        at = end + 4 + int(stated)
        while data.startswith(b"\r\n", at):
            at += 2


def response_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """The response records of WARC files, one file a row (as Spark's ``binaryFile`` source reads them): ``record_id``, ``target_uri``, ``warc_date``, ``block`` and ``warc_headers``.

    Files are independent; one is held by its task.  A null or damaged file gives the
    records before the damage; repeated files give repeated rows; other columns are not read.
    """
    require(files, content)
    names = ("warc-record-id", "warc-target-uri", "warc-date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for headers, block in parse_records(data.as_py() or b""):
                    about = {k.lower(): v for k, v in headers}
                    if about.get("warc-type", "").lower() == "response":
                        found = [about.get(n, "").strip("<>" if n == "warc-target-uri" else "") for n in names]
                        row = [*([x] for x in found), [block], [[{"name": k, "value": v} for k, v in headers]]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _RESPONSE, strict=True)], names=["record_id", "target_uri", "warc_date", "block", "warc_headers"])

    return files.select(content).mapInArrow(run, f"record_id string, target_uri string, warc_date string, block binary, warc_headers {HEADERS}")


HEADERS = "array<struct<name:string,value:string>>"
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_RESPONSE = (pa.string(), pa.string(), pa.string(), pa.binary(), _PAIRS)


def derive(record_id: str, target: str, date: str, block: bytes, given: list[tuple[str, str]] = ()) -> list[dict]:
    """The metadata and the conversion record of one response, whose own WARC headers may be ``given``.

    Given digests are carried over; one that the bytes do not bear out (of a kind that
    can be checked) is named in the metadata.
    """
    status, headers, body = http_message(block)
    charset, page = decoded(headers, body)
    tree = parse(page)
    title, links = "", []
    stack = [tree]
    while stack:
        node = stack.pop()
        if node.tag == "title" and not title:
            title = tidy("".join(c for c in node.children if isinstance(c, str)))
        elif node.tag == "a":
            href = node.get("href")
            if href:
                links.append(" ".join(href.split()))
        stack.extend(c for c in reversed(node.children) if c.__class__ is Node)
    text = "\n".join(blocks(tree, lambda n: n.tag in _INVISIBLE))
    stated = {k.lower(): v for k, v in given}
    digests, doubts = {}, []
    for kind, data in (("block", block), ("payload", body)):
        own = digest(data)
        digests[kind] = stated.get(f"warc-{kind}-digest") or own
        if digests[kind].lower().startswith("sha1:") and digests[kind].lower() != own.lower():
            doubts.append(("digest-mismatch", f"{kind} {own}"))
    fields = [*(("warc-header", f"{k}: {v}") for k, v in given), *doubts, ("http-status", status), *(("http-header", f"{k}: {v}") for k, v in headers), ("charset", charset), ("title", title), *(("outlink", x) for x in links)]
    source = [("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Source-Block-Digest", digests["block"]), ("WARC-Source-Payload-Digest", digests["payload"])]
    made = (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    ids = {kind: urn(record_id, kind) for kind, _, _ in made}
    rows = []
    for kind, content_type, own in made:
        other = ids["conversion" if kind == "metadata" else "metadata"]
        head = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", target), *source, ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(own)), ("Content-Type", content_type)]
        rows.append({"warc_type": kind, "record_id": ids[kind], "refers_to": record_id, "concurrent_to": other, "target_uri": target, "warc_date": date, "content_type": content_type, "source_block_digest": source[3][1], "source_payload_digest": source[4][1], "block_digest": digest(own), "content_length": len(own), "block": own.decode("utf-8", "replace"), "record": record(head, own)})
    return rows


_COLUMNS = (*((c, pa.string()) for c in "warc_type record_id refers_to concurrent_to target_uri warc_date content_type source_block_digest source_payload_digest block_digest".split()), ("content_length", pa.int64()), ("block", pa.string()), ("record", pa.binary()))
SCHEMA = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in _COLUMNS)


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) as response rows: ``page_id``, ``record_id``, ``target_uri``, ``warc_date``, ``block``.

    Null texts count as empty; rows that repeat give equal responses.
    """
    require(pages, "page_id", "url", "html")
    url, body = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    h = F.sha1(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, body))
    record_id = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id"), record_id.alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, body).cast("binary").alias("block"))


def derivatives(df: DataFrame, keep: str | None = "page_id") -> DataFrame:
    """Two rows per response (the columns of ``SCHEMA``), with the column ``keep`` passed through if given.

    * A column ``warc_headers`` (names and values, as of :func:`response_rows`) is used if there is one: all of them stand in the metadata record, and digests are carried over.
    * A null block counts as empty: its records have no headers, title, links or text.
    * A null id, URI or date counts as empty text; other columns are not read, so none can clash.
    * Pages are converted whole, however long; repeated rows give repeated records with equal ids.
    * Empty input: empty result.
    """
    names = ("record_id", "target_uri", "warc_date", "block")
    require(df, *names, *([keep] if keep else []))
    if keep in {n for n, _ in _COLUMNS}:
        raise ValueError(f"{keep} is a column of the result")
    given = df.select(*([F.col(keep)] if keep else []), *(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names[:-1]), F.col("block"), (F.col("warc_headers") if "warc_headers" in df.columns and keep != "warc_headers" else F.lit(None)).cast(HEADERS).alias("__given"))
    prefix = f"`{keep}` {dict(given.dtypes)[keep]}, " if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "block"):
                made = [derive(i, u, d, b or b"", [(x["name"] or "", x["value"] or "") for x in g or () if x]) for i, u, d, b, g in zip(*(part.column(n).to_pylist() for n in (*names, "__given")), strict=True)]
                rows = [r for two in made for r in two]
                arrays = [pa.array([r[n] for r in rows], t) for n, t in _COLUMNS]
                if keep:
                    arrays.insert(0, part.column(keep).take(pa.array([i for i, two in enumerate(made) for _ in two], pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*([keep] if keep else []), *(n for n, _ in _COLUMNS)])

    return given.mapInArrow(run, prefix + SCHEMA)
