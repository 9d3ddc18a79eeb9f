"""WARC derivatives: linked metadata and plain-text conversion records from response records.

A response is a row of ``record_id, target_uri, date, http_headers, payload``. Each
gives two records that refer to it, with the source's headers and digests kept. It
is one pass without a shuffle: a page is read once, in Python, for its text, title,
language and links; ids, digests and records are made by Spark's own functions.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches

#: Elements that begin a new line of text, and elements without text.
BLOCK_TAGS = frozenset("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr table article section nav header footer main aside body html head blockquote pre form figure".split())
SILENT_TAGS = ("script", "style", "noscript", "template", "title")
CRAWL_DATE = "2024-01-01T00:00:00Z"
#: Stand for a line break that an element makes, and for other markup until references are read; in the page itself they are blanks.
_BREAK, _NOTHING = "\x1e", "\x1f"
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: A comment, a silent element with what is in it, a tag, or another declaration. What is not closed ends with the page.
_MARKUP = re.compile(rf"""<(?:!--.*?(?:--!?>|\Z)|({"|".join(SILENT_TAGS)})(?=[\s/>])(?:{_ATTRIBUTES}|[^>]*)>(.*?)(?:</\1\s*[^>]*>|\Z)|(/?)([a-z][^\s/>]*)({_ATTRIBUTES}|[^>]*)>|[!?/][^>]*(?:>|\Z))""", re.S | re.I)
_HREF = re.compile(r"""\shref\s*=""", re.I)
_LANG = re.compile(r"""\slang\s*=\s*["']?([A-Za-z-]+)""", re.I)


def read_page(page: str | None) -> tuple[str, str, str, int]:
    """Text, title, declared language (lower case) and number of links out of an HTML page.

    Blocks begin lines, other tags and comments leave nothing, character references
    are read once, and white space of any kind is one blank.
    """
    found = {"title": None, "lang": None, "links": 0}

    def instead(m: re.Match) -> str:
        silent, inner, closing, name, attributes = m.groups()
        if name is None:
            if silent and found["title"] is None and silent.lower() == "title":
                found["title"] = inner
            return _NOTHING
        name = name.lower()
        if not closing:
            if name == "a" and _HREF.search(attributes):
                found["links"] += 1
            elif name == "html" and found["lang"] is None and (lang := _LANG.search(attributes)):
                found["lang"] = lang[1]
        return _BREAK if name in BLOCK_TAGS else _NOTHING

    text = html.unescape(_MARKUP.sub(instead, (page or "").replace(_BREAK, " ").replace(_NOTHING, " ")))
    lines = [" ".join(x.split()) for x in text.replace(_NOTHING, "").split(_BREAK)]
    return "\n".join(x for x in lines if x), " ".join(html.unescape(found["title"] or "").split()), (found["lang"] or "").lower(), found["links"]


def _pages(payload: Column) -> Column:
    """:func:`read_page` as a struct ``text, title, lang, links``, a batch at a time."""

    def read(pages: pa.Array) -> pa.Array:
        rows = [read_page(x) for x in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["text", "title", "lang", "links"])

    return F.arrow_udf(read, "text string, title string, lang string, links long", F.ArrowUDFType.SCALAR)(payload)


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid derived from the record's kind and source, the same in each run."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses_from_pages(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """Response rows of ``page_id, url, html``; ``page_id`` stays as ``source_id``."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").alias("source_id"), record_id("response", F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), F.col("html").alias("payload"))


def derived_records(responses: DataFrame) -> DataFrame:
    """A ``metadata`` and a ``conversion`` record for each response.

    Columns: ``source_id, warc_type, record_id, refers_to, target_uri, date,
    content_type, source_content_type, source_length, source_digest, block_digest,
    content_length, block, http_headers``, the last being the source's as they are. A
    null payload counts as empty and gives an empty conversion; a null address stays
    null; repeated rows give repeated records of the same ids. Other columns are not
    kept. An empty table gives no rows.
    """
    python_batches(responses.sparkSession)
    content_type = F.regexp_extract("http_headers", r"(?i)content-type:[ \t]*([^\r\n]*)", 1)
    payload = F.coalesce("payload", F.lit(""))
    base = responses.select("source_id", "record_id", "target_uri", "date", content_type.alias("source_content_type"), F.octet_length(payload).cast("long").alias("source_length"), _digest(F.col("payload")).alias("source_digest"), "http_headers", _pages(payload).alias("page"))
    fields = F.concat(F.lit("title: "), F.col("page.title"), F.lit("\r\nlanguage: "), F.col("page.lang"), F.lit("\r\noutlinks: "), F.col("page.links").cast("string"), F.lit("\r\n"))
    made = [F.struct(F.lit(kind).alias("warc_type"), record_id(kind, F.col("record_id")).alias("new_id"), F.lit(kind_type).alias("content_type"), block.alias("block")) for kind, kind_type, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", F.col("page.text")))]
    rows = base.select("*", F.explode(F.array(*made)).alias("r"))
    return rows.select("source_id", "r.warc_type", F.col("r.new_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "r.content_type", "source_content_type", "source_length", "source_digest", _digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block", "http_headers")


#: WARC fields by column; each line of the source's headers follows as a field of its own.
_FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "block_digest": "WARC-Block-Digest", "source_content_type": "WARC-Source-Content-Type", "source_digest": "WARC-Source-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
_SOURCE_LINE = "WARC-Source-HTTP-Header: "
_VERSION, _GAP = "WARC/1.1\r\n", "\r\n\r\n"


def rendered(records: DataFrame) -> DataFrame:
    """``record_id, record``: each derived record as WARC/1.1 text, ready to be written one after another.

    Each line of the source's headers, its status line first, is a ``WARC-Source-HTTP-Header`` of its own.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    source = F.transform(F.filter(F.split(F.coalesce("http_headers", F.lit("")), r"\r?\n"), lambda x: x != ""), lambda x: F.concat(F.lit(_SOURCE_LINE), x, F.lit("\r\n")))
    head = F.concat(F.lit(_VERSION), *[line(n, F.col(c)) for c, n in _FIELDS.items()], F.array_join(source, ""), F.lit("\r\n"))
    return records.select("record_id", F.concat(head, "block", F.lit(_GAP)).alias("record"))


def write_records(records: DataFrame, folder: str) -> None:
    """Write the records as WARC files, a file a partition."""
    whole = rendered(records).select(F.expr(f"left(record, length(record) - {len(_GAP)})").alias("value"))
    whole.write.option("lineSep", _GAP).text(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of WARC files of :func:`write_records`: the fields' columns, ``http_headers`` and ``block``.

    Files are split between records. A block whose length is not the stated one fails the read.
    """
    raw = spark.read.option("lineSep", _GAP + _VERSION).text(folder).select(F.regexp_replace("value", rf"\A{re.escape(_VERSION)}", "").alias("v"))
    head = F.substring_index("v", _GAP, 1)
    field = lambda name: F.regexp_extract(head, rf"(?:\A|\n){name}: ([^\r\n]*)", 1)
    length = field("Content-Length").cast("long")
    rest = F.expr(f"substring(v, length(substring_index(v, '{_GAP}', 1)) + {len(_GAP) + 1})".replace("\r", "\\r").replace("\n", "\\n"))
    block = F.regexp_replace(rest, r"(?:\r\n){2}\z", "")
    block = F.when(F.octet_length(rest) == length, rest).when(F.octet_length(block) == length, block).otherwise(F.raise_error(F.lit("a record's block is not as long as it says")))
    lines = F.regexp_extract_all(head, F.lit(rf"(?:\A|\n){_SOURCE_LINE}([^\r\n]*)"), F.lit(1))
    columns = [(length if c == "content_length" else F.when(head.contains(f"\n{n}: ") | head.startswith(f"{n}: "), field(n))).alias(c) for c, n in _FIELDS.items()]
    return raw.select(*columns, F.concat(F.array_join(lines, "\r\n"), F.lit(_GAP)).alias("http_headers"), block.alias("block"))


def _unpacked(data: bytes) -> bytes:
    """A file's bytes; gzip members one after another are put together."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out, rest = [], data
    while rest.strip(b"\0"):
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(rest) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        rest = member.unused_data
    return b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    """Fields of a head by lower-case name; the first of a name counts, and a line that begins with a blank goes on with the one before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines()[1:]
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def split_records(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """Version, fields and block of each record of a WARC file, of any version; a block is as long as it says, whatever is in it."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = _HEAD_END.search(data, at)
        if not data.startswith(b"WARC/", at) or end is None:
            raise ValueError(f"no record at byte {at}")
        fields = _fields(data[at : end.start()])
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"no length of the record at byte {at}")
        stop = end.end() + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield data[at : end.start()].split(b"\n", 1)[0].strip().decode("latin-1"), fields, data[end.end() : stop]
        at = stop


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (line := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(body, at)) and (n := int(line[1], 16)):
        out.append(body[line.end() : line.end() + n])
        at = line.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(out)


def _payload(http: dict[str, str], body: bytes) -> str:
    """The text of an HTTP body: transfer chunks joined, gzip and deflate undone, decoded by its charset (else UTF-8); what cannot be read stays or is replaced."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding, wbits in (("gzip", 31), ("deflate", 15)):
        if coding in http.get("content-encoding", "").lower():
            try:
                body = zlib.decompress(body, wbits)
            except zlib.error:
                pass
    charset = re.search(r"charset=\"?([\w.:-]+)", http.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


RESPONSE = "source_id string, record_id string, target_uri string, date string, http_headers string, payload string, warc_version string, file string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (``*.warc``, ``*.warc.gz``, any version, gzip by record or whole) as rows for :func:`derived_records`.

    Other records are passed over. Records are read by their stated length, as bytes; a file that is cut short, or is none, fails the read with its name.
    A file is read by Spark as one row, so it must fit a task's memory; such files are kept near 1 GB. The record's own id
    is the ``source_id``. A response without HTTP headers has an empty payload.
    """
    python_batches(spark)

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    for version, fields, block in split_records(_unpacked(content)):
                        if fields.get("warc-type", "").lower() != "response":
                            continue
                        end = _HEAD_END.search(block)
                        head, body = (block[: end.end()], block[end.end() :]) if end else (block, b"")
                        rows.append((fields.get("warc-record-id"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), head.decode("latin-1"), _payload(_fields(head), body), version, file))
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    names = [c.split(" ")[0] for c in RESPONSE.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    # Arrow batches are bounded by bytes, so a large file is a batch by itself
    return files.select("path", "content").mapInArrow(read, RESPONSE)
