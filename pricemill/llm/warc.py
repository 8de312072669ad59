"""WARC derivatives: for each response a metadata record and a plain-text conversion record.

Both point to the response (WARC-Refers-To, its target URI and date) and carry its target URI; the
metadata record keeps the response's HTTP headers, payload digest and out-links, and names the
conversion record made with it. Each record's own block digest is that of the bytes it holds.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VERSION = "WARC/1.1"
#: Date of responses that are built from tables without one.
NO_DATE = "1970-01-01T00:00:00Z"
#: Bytes of content that are undone of a response, of a gzip member that are unpacked, and of one step of either.
MOST_CONTENT, MOST_MEMBER, PIECE = 64 << 20, 512 << 20, 1 << 20

#: Elements of which nothing is text, and the places where one or a comment may begin.
_HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
_HIDES = re.compile(r"<(?:!--|(%s)\b)" % "|".join(_HIDDEN), re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_HIDDEN, "title")}
_BREAKS = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|blockquote|pre)|br|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>", re.I)
_LINK, _ROOT = re.compile(r"<a\b", re.I), re.compile(r"<html\b", re.I)
_HREF, _LANG = re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"\blang\s*=\s*", re.I)
_VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode("ascii")


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; the digest and the length of its block are added to the fields."""
    fields = [*fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"])
    return head.encode("utf-8") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record; ValueError if it is none or cut short."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields.get("content-length", len(rest)))
    if len(rest) < n:
        raise ValueError("the record is cut short")
    return fields, rest[:n]


def record_id(*parts: str) -> str:
    """The same identifier for the same parts, so that a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def response(key: str, url: str | None, body: str | None, date: str = NO_DATE) -> bytes:
    """A response record of a page."""
    payload = (body or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    uri = re.sub(r"[\r\n]+", "", url or "")
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, uri)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)),
    ]
    return record(fields, http + payload)


def _visible(page: str) -> str:
    """The page with a blank for each comment and each element whose content is no text. What has no end is
    left as it is; an end that wasn't found once is not looked for again, so the time is linear."""
    kept, at, without = [], 0, set()
    m = _HIDES.search(page)
    while m:
        name, end = (m[1] or "!--").lower(), -1
        if name not in without:
            if name == "!--":
                end = page.find("-->", m.end()) + 3
                found = end > 2
            else:
                opened = page.find(">", m.end())
                close = _CLOSES[name].search(page, opened + 1) if opened >= 0 else None
                found, end = close is not None, close.end() if close else -1
            if found:
                kept += [page[at : m.start()], " "]
                at = end
            else:
                without.add(name)
                end = -1
        m = _HIDES.search(page, end if end >= 0 else m.end())
    return "".join([*kept, page[at:]])


def plain_text(page: str) -> str:
    """The text of a page: without scripts, styles, head and comments; block elements end a line."""
    text = _TAG.sub("", _BREAKS.sub("\n", _visible(page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip()


def _title(page: str) -> str:
    opened = _TITLE.search(page)
    closed = opened and _CLOSES["title"].search(page, opened.end())
    return plain_text(page[opened.end() : closed.start()]) if closed else ""


def attributes(page: str, tag: re.Pattern, name: re.Pattern) -> Iterator[str]:
    """The values of an attribute in all tags of a kind; a tag reaches to the next > or the page's end."""
    m, end = tag.search(page), -1
    while m:
        if end < m.end():
            end = page.find(">", m.end())
            end = len(page) if end < 0 else end
        found = name.search(page, m.end(), end)
        value = found and _VALUE.match(page, found.end())
        if value:
            yield html.unescape(value[1] or value[2] or value[3] or "")
        m = tag.search(page, value.end() if value else end)


def _unchunked(body: bytes) -> bytes:
    """The content of chunks, as far as they can be read."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:line].partition(b";")[0], 16)
        except ValueError:
            break
        if n <= 0:
            break
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return b"".join(out)


def _pieces(unpack, body: bytes, most: int) -> tuple[bytes, bytes, bool]:
    """(what a zlib object makes of a body, at most so much; what follows its end; whether there was more)."""
    out, size, rest = [], 0, body
    while rest and not unpack.eof:
        try:
            out.append(unpack.decompress(rest, min(PIECE, most - size + 1)))
        except zlib.error:
            if not size:
                raise
            break  # damaged further on: what was read stays
        size += len(out[-1])
        rest = unpack.unconsumed_tail
        if size > most:
            return b"".join(out)[:most], b"", True
    return b"".join(out), unpack.unused_data, False


def _unzipped(body: bytes, most: int) -> tuple[bytes, bool] | None:
    """All members of a gzip or zlib body, or a bare deflate one; None where nothing can be read."""
    for bits in (47, -15):
        out, size, rest = [], 0, body
        try:
            while rest:
                part, rest, more = _pieces(zlib.decompressobj(bits), rest, most - size)
                out.append(part)
                size += len(part)
                if more:
                    return b"".join(out), True
                if rest[:2] != b"\x1f\x8b":
                    break  # padding, or bytes that are no member
        except zlib.error:
            if not out:
                continue
        return b"".join(out), False
    return None


def _unzstd(body: bytes, most: int) -> tuple[bytes, bool] | None:
    try:
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(body, read_across_frames=True) as read:
            out = read.read(most + 1)
    except zstandard.ZstdError:
        return None
    return out[:most], len(out) > most


_UNDO = {"gzip": _unzipped, "x-gzip": _unzipped, "deflate": _unzipped, "zstd": _unzstd}


def _decoded(body: bytes, codings: list[str], most: int) -> tuple[bytes, str, bool]:
    """A body with its content codings undone from the last to the first: (content, the coding that could not be undone or an
    empty text, whether it was cut at `most` bytes). A body that says it is zipped but does not begin so is taken as it is."""
    cut = False
    for coding in reversed(codings):
        if coding in ("", "identity"):
            continue
        undo = _UNDO.get(coding)
        if undo is None:
            return body, coding, cut
        found = undo(body, most)
        if found is None:
            return (body, "", cut) if coding != "zstd" or body[:4] != b"\x28\xb5\x2f\xfd" else (body, coding, cut)
        body, more = found
        cut = cut or more
    return body, "", cut


def _text(content: bytes, charset: str) -> tuple[str, bool]:
    """(the text of a content, whether its character set is known). An unknown one, or one that is none of texts, is read as
    UTF-8; lone surrogates, which some codecs make, become replacement marks."""
    try:
        page, known = content.decode(charset, "replace"), True
    except (LookupError, ValueError):
        page, known = content.decode("utf-8", "replace"), False
    try:
        page.encode("utf-8")
    except UnicodeEncodeError:
        page = page.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return page, known


def _http(block: bytes, most: int) -> tuple[str, list[str], bytes, bytes, str, list[tuple[str, str]]]:
    """Status line, header lines, payload as sent, content with its codings undone (at most so many bytes), character set,
    and what could not be done, of an HTTP response. A payload that says it is coded but isn't is taken as it is;
    one in a coding that is not known has no content."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in reversed(headers))}
    content = payload
    if fields.get("transfer-encoding", "").lower().endswith("chunked"):
        content = _unchunked(payload) or payload
    content, left, cut = _decoded(content, [c.strip().lower() for c in fields.get("content-encoding", "").split(",")], most)
    notes = [("content-not-decoded", left)] if left else []
    notes += [("content-cut-at", str(most))] if cut else []
    charset = _CHARSET.search(fields.get("content-type", ""))
    return status, headers, payload, b"" if left else content, charset[1] if charset else "utf-8", notes


def derive(raw: bytes | None, most: int = MOST_CONTENT) -> list[dict]:
    """The metadata and conversion records of a response record; nothing for other records. Content is undone up to `most`
    bytes. The metadata say so where content was cut there, where its coding or its character set is not known."""
    try:
        fields, block = parse(raw or b"")
    except ValueError:
        return []
    if fields.get("warc-type") != "response":
        return []
    status, headers, payload, content, charset, notes = _http(block, most)
    page, known = _text(content, charset)
    notes += [] if known else [("charset-not-known", charset)]
    source, uri, date = fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", NO_DATE)
    ids = {kind: record_id(kind, source, uri) for kind in ("metadata", "conversion")}
    language = re.match(r"[A-Za-z\-]*", next(attributes(page, _ROOT, _LANG), ""))[0]
    payload_digest = fields.get("warc-payload-digest") or digest(payload)
    links = dict.fromkeys(attributes(page, _LINK, _HREF))
    described = [
        ("source-status", status), *(("source-header", h) for h in headers), ("source-block-digest", fields.get("warc-block-digest") or digest(block)),
        ("source-payload-digest", payload_digest), ("conversion", ids["conversion"]), ("title", _title(page)), ("language", language),
        *notes, *(("outlink", x) for x in links),
    ]
    body = "".join(f"{k}: {_BLANKS.sub(' ', v).replace(chr(10), ' ')}\r\n" for k, v in described).encode("utf-8", "replace")
    text = plain_text(page)
    out = []
    for kind, mime, block_ in (("metadata", "application/warc-fields", body), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        head = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("Content-Type", mime),
        ]
        out.append({
            "record_type": kind, "record_id": ids[kind], "refers_to": source, "target_uri": uri, "source_payload_digest": payload_digest,
            "block_digest": digest(block_), "n_bytes": len(block_), "text": text if kind == "conversion" else None, "record": record(head, block_),
        })
    return out


_RECORD = {"record_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "source_payload_digest": "string", "block_digest": "string", "n_bytes": "long", "text": "string", "record": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _each(source: str, make_records):
    """For each row (key, *source) the key and its records."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 128):
                b = whole.slice(first, 128)
                rows = [(k, r) for k, *x in zip(b.column(0), *(b.column(c).to_pylist() for c in source.split(","))) for r in make_records(str(k.as_py()), *x)]
                names = [pa.array([k.as_py() for k, _ in rows], b.schema.field(0).type), *(pa.array([r[c] for _, r in rows], _ARROW[t]) for c, t in _RECORD.items())]
                yield pa.RecordBatch.from_arrays(names, names=[b.schema.names[0], *_RECORD])

    return make


def _derived(df: DataFrame, key: str, source: str, make_records) -> DataFrame:
    """The key (under its name, even where a derivative has a column so called) and a derivative's columns."""
    kind = df.schema[key].dataType.simpleString()
    inner = df.select(F.col(key).alias("__key"), *source.split(","))
    out = inner.mapInArrow(_each(source, make_records), f"__key {kind}, " + ", ".join(f"{c} {t}" for c, t in _RECORD.items()))
    return out.select(F.col("__key").alias(key), *(c for c in _RECORD if c.lower() != key.lower()))


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response of records (key, record binary): the key and the columns of a
    derivative. Null, damaged and other records give no rows; repeated ones give their rows again. Bodies of
    any number of gzip members, deflate and zstd are undone, up to MOST_CONTENT bytes; in other codings a body has no text.
    Metadata name a coding or a character set that is not known, and a cut. A derivative's column that is called like the key is left out. Other columns are not looked at."""
    return _derived(records, key, "record", lambda _, raw: derive(raw))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """(page_id, record) of a table of pages; a null url or body counts as empty."""
    make = F.pandas_udf(lambda k, u, h: k.combine(u.combine(h, lambda x, y: (x, y)), lambda key, own: response(str(key), own[0], own[1], date)), "binary")
    return pages.select("page_id", make(F.col("page_id").cast("string"), "url", "html").alias("record"))


def page_derivatives(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """derivatives(responses(pages)) in one pass over the pages."""
    return _derived(pages, "page_id", "url,html", lambda key, url, body: derive(response(key, url, body, date)))


def _records(blob: bytes) -> Iterator[bytes]:
    """The records that follow each other in bytes that are not compressed."""
    at = 0
    while (head := blob.find(b"\r\n\r\n", at)) >= 0:
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", blob[at : head + 2])
        if not length or not blob.startswith(b"WARC/", at):
            return
        end = head + 4 + int(length[1])
        yield blob[at:end]
        at = end + (4 if blob.startswith(b"\r\n\r\n", end) else 0)


def _unpacked(blob: bytes, at: int, most: int) -> tuple[bytes | None, int]:
    """(the member that begins at a place, None if it is larger than `most`; where it ends). It is fed in growing pieces, so
    what follows it is not copied."""
    unpack, out, size, piece = zlib.decompressobj(31), [], 0, 1 << 12
    while not unpack.eof:
        fed = blob[at : at + piece]
        if not fed:
            raise zlib.error("the member is cut short")
        at, piece = at + len(fed), min(2 * piece, PIECE)
        while fed and not unpack.eof:
            part = unpack.decompress(fed, PIECE)
            fed, size = unpack.unconsumed_tail, size + len(part)
            if size <= most:
                out.append(part)
            else:
                out.clear()
    return b"".join(out) if size <= most else None, at - len(unpack.unused_data)


def _members(blob: bytes, most: int = MOST_MEMBER) -> Iterator[bytes]:
    """A file's records: of a compressed file each gzip member holds some, of a plain one they follow. A member that unpacks to
    more than `most` bytes, or is packed more than once over, is left out; what follows damage too."""
    if blob[:2] != b"\x1f\x8b":
        yield from _records(blob)
        return
    at = 0
    while blob[at : at + 2] == b"\x1f\x8b":
        try:
            member, at = _unpacked(blob, at, most)
        except zlib.error:
            return
        if member is not None:
            yield from _records(member)
        while blob[at : at + 1] == b"\0":  # padding between members
            at += 1


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, record) of the records of WARC files, plain or compressed by record. A file is read
    whole by one task, so it must fit one (2 GB at most), in time in proportion to its length; what follows damage
    in a file is left out, and so is a member that unpacks to more than MOST_MEMBER bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, blob in zip(b.column("path").to_pylist(), b.column("content")):
                for i, raw in enumerate(_members(blob.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int64()), pa.array([raw], pa.binary())], names=["file", "place", "record"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(make, "file string, place long, record binary")


def write_warc(records: DataFrame, folder: str, per_file: int = 10_000) -> str:
    """Writes the column record as files of a gzip member a record, so many records a file. Null records
    are left out. The rows' order within their partitions is kept."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for raw in b.column("record").to_pylist():
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed.append(pack.compress(raw) + pack.flush())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    # a gzip reader skips the padding of zeros that ends each row of the text writer
    body = records.where("record is not null").select("record").mapInArrow(make, "value binary").select(F.col("value").cast("string"))
    body.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)
    return folder


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every whole page of pages."""
    return page_derivatives(table(spark, sf_dir, "pages"))
