"""WARC derivatives: metadata and plain-text conversion records made from response records.

Both derivatives of a response name it in ``refers_to``, keep its target and date, and carry the digest
of its payload, as its record states it, next to that of their own block. Record identifiers are derived
from the response's, so a second run makes the same records. Records are written as WARC/1.1, singly or
as gzip members, and read back from blobs of any number of records; blocks are bytes throughout, and
become text only where a conversion is made (UTF-8, or Latin-1 where the HTTP header says so).

Defined results: a null or empty payload gives an empty conversion and a title that is empty; a null
target stays null and its record identifier is made from the empty text; rows that repeat give equal
records each; bytes that aren't UTF-8 become the replacement character in texts and stay as they are
in payloads; line ends in header fields become blanks; a record that is cut off has what there is, and
what isn't a record is passed over; a very long record is one row's work, in proportion to it; an empty
table gives an empty result; columns named in ``carry`` are kept, others ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

CRLF = "\r\n"
#: What ends a line of text; all other tags vanish.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|title|tr|ul"
#: Named character references that are replaced, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_STEPS = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<(?:script|style|noscript|template)\b.*?(?:</(?:script|style|noscript|template)\s*>|\z)", ""),
    (r"[ \t\r\n\f\x0B]+", " "),
    (rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"),
    (r"</?[A-Za-z!][^>]*>", ""),
    (r" +", " "),
    (r" ?\n[ \n]*", "\n"),
)


def plain_text(html: Column) -> Column:
    """The readable text of ``html``: one line for each block, references resolved, blanks collapsed."""
    text = html
    for pattern, to in _STEPS:
        text = F.regexp_replace(text, pattern, to)
    for name, to in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(to))
    return F.btrim(text, F.lit(" \n"))


def _urn(key: Column) -> Column:
    h = F.md5(key)
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, key: str = "page_id", date: str = "1970-01-01T00:00:00Z", carry: tuple[str, ...] = ()) -> DataFrame:
    """Response records of crawled ``pages`` (``key``, url, html), with the payload as bytes."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(
        *carry,
        _urn(F.concat_ws("|", F.lit("response"), F.col(key).cast("string"), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), header.alias("http_header"), payload.alias("payload"), _digest(payload).alias("payload_digest"),
    )


def as_records(made: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """:func:`responses`' rows in the columns of :func:`derive`'s, ready to be written."""
    block = F.concat(F.coalesce("http_header", F.lit("")).cast("binary"), F.lit(CRLF).cast("binary"), F.coalesce("payload", F.lit(b"")))
    rows = made.select(*carry, "record_id", "target_uri", "warc_date", "payload_digest", block.alias("block"))
    return rows.select(
        *carry, F.lit("response").alias("record_type"), "record_id", F.lit(None).cast("string").alias("refers_to"), "target_uri", "warc_date", "payload_digest",
        F.lit("application/http; msgtype=response").alias("content_type"), F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"), "block",
    )


def text_of(payload: Column, header: Column) -> Column:
    """The bytes ``payload`` as text: Latin-1 where ``header`` says so, else UTF-8 with replacements."""
    latin = F.lower(F.coalesce(header, F.lit(""))).rlike(r"charset=[\"']?(?:iso-8859-1|latin-?1|windows-1252)\b")
    return F.when(latin, F.decode(payload, "ISO-8859-1")).otherwise(F.make_valid_utf8(payload.cast("string")))


def derive(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The metadata and conversion records of response ``records``, in the columns of :func:`responses`' rows.

    No row meets another: a task reads responses and writes twice as many records.
    """
    records = records.withColumn("payload", F.coalesce(text_of(F.col("payload").cast("binary"), F.col("http_header")), F.lit("")))
    payload = F.col("payload")
    title = F.btrim(F.regexp_replace(F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "), F.lit(" "))
    lang = F.regexp_extract(payload, r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    links = F.regexp_extract_all(payload, F.lit(r"(?i)<a\b[^>]*?\bhref=[\"']([^\"'<>]*)[\"']"), F.lit(1))
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), lang, F.lit("\r\n"), F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit("\r\n"))), ""), F.lit("source-header: "), F.replace(F.btrim(F.coalesce("http_header", F.lit("")), F.lit("\r\n")), F.lit(CRLF), F.lit("\r\nsource-header: ")), F.lit(CRLF))
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("block")),
    )
    rows = records.select(*carry, F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", F.explode(made).alias("r"))
    return rows.select(
        *carry, "r.record_type", _urn(F.concat_ws("|", F.col("r.record_type"), F.col("refers_to"))).alias("record_id"), "refers_to", "target_uri", "warc_date", "payload_digest",
        "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"), "r.block",
    )


def serialise(records: DataFrame, carry: tuple[str, ...] = (), gzip: bool = False) -> DataFrame:
    """(*carry, record_id, record: binary): each of :func:`derive`'s records as the bytes of a WARC/1.1 file, or as a gzip member."""
    clean = lambda value: F.regexp_replace(value, r"[\r\n]+", " ")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), clean(F.col(value).cast("string")), F.lit(CRLF)), F.lit(""))
    fields = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = F.concat(F.lit("WARC/1.1\r\n"), *[line(name, value) for name, value in fields], F.lit(CRLF))
    whole = records.select(*carry, "record_id", F.concat(head.cast("binary"), F.col("block").cast("binary"), F.lit("\r\n\r\n").cast("binary")).alias("record"))
    if not gzip:
        return whole

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in batch.column(batch.num_columns - 1):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed.append(z.compress(x.as_py()) + z.flush())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=batch.schema.names)

    return map_batches(whole, pack, whole.schema)


def _members(blob: bytes) -> Iterator[bytes]:
    """The parts of ``blob``: what each gzip member holds, and what stands plain, in order."""
    at = 0
    while at < len(blob):
        if blob[at : at + 2] != b"\x1f\x8b":
            yield blob[at:]
            return
        unpack, parts = zlib.decompressobj(31), []
        try:
            while not unpack.eof and at < len(blob):
                step = blob[at : at + 65536]
                parts.append(unpack.decompress(step))
                at += len(step) - len(unpack.unused_data)
        except zlib.error:
            at = len(blob)
        yield b"".join(parts)


def read_records(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record in ``blob``, which may be plain or of gzip members."""
    for data in _members(blob):
        at = data.find(b"WARC/")
        while at >= 0:
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            start = end + 4
            length = fields.get("content-length", "")
            if length.isascii() and length.isdigit():
                stop = min(len(data), start + int(length))
            else:  # up to what begins like the next record
                stop = data.find(b"\r\n\r\nWARC/", start)
                stop = len(data) if stop < 0 else stop
            yield fields, data[start:stop]
            at = data.find(b"WARC/", stop)


_FIELDS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest", "content-type")


def records(files: DataFrame, carry: tuple[str, ...] = (), batch_bytes: int = 1 << 20) -> DataFrame:
    """Every record in ``files`` (*carry, record: binary, of any number of records): its fields, its block, and of a
    response the HTTP header and payload. A payload's digest is the one that the record states, or else made here."""
    names = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "stated_digest", "block_digest", "content_type", "http_header", "block", "payload")
    kinds = [pa.string()] * 9 + [pa.binary()] * 2
    schema = files.select(*carry).schema
    for name, kind in zip(names, kinds, strict=True):
        schema = schema.add(name, "string" if kind == pa.string() else "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rows, size = [], [], 0

            def flush(batch=batch) -> pa.RecordBatch:
                columns = list(zip(*made, strict=True))
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:-1]), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-1], *names])

            for i, blob in enumerate(batch.column(batch.num_columns - 1)):
                for fields, block in read_records(blob.as_py() or b""):
                    header = payload = None
                    if fields.get("warc-type", "").lower() == "response":
                        cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
                        header, payload = (block[: cut + 2].decode("utf-8", "replace"), block[cut + 4 :]) if cut >= 0 else (None, block)
                    made.append((*(fields.get(f) for f in _FIELDS), header, block, payload))
                    rows.append(i)
                    size += len(block)
                    if size >= batch_bytes:
                        yield flush()
                        made, rows, size = [], [], 0
            if made:
                yield flush()

    got = map_batches(files.select(*carry, "record"), read, schema)
    return got.withColumn("payload_digest", F.coalesce("stated_digest", F.when(F.col("payload").isNotNull(), _digest(F.col("payload"))))).drop("stated_digest")


def parse(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The response records in ``files`` (*carry, record: binary), in the columns of :func:`responses`."""
    got = records(files, carry).where(F.lower("record_type") == "response")
    return got.select(*carry, "record_id", "target_uri", "warc_date", "http_header", "payload", "payload_digest")


def _sql_text(html: str) -> str:
    for pattern, to in _STEPS:
        html = f"regexp_replace({html}, '{pattern}', {"chr(10)" if to == chr(10) else f"'{to}'"}, 'g')"
    for name, to in ENTITIES:
        html = f"replace({html}, '{name}', '{"''" if to == "'" else to}')"
    return f"trim({html}, ' ' || chr(10))"


def _sql_urn(key: str) -> str:
    h = f"md5({key})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


SQL = rf"""
WITH r AS (
  SELECT page_id, url AS target_uri, '1970-01-01T00:00:00Z' AS warc_date, coalesce(html, '') AS payload,
    {_sql_urn("'response|' || page_id || '|' || coalesce(url, '')")} AS refers_to
  FROM pages
), d AS (
  SELECT page_id, target_uri, warc_date, refers_to, 'sha256:' || sha256(payload) AS payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g'), ' ')
    || chr(13) || chr(10) || 'language: ' || regexp_extract(payload, '(?is)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1) || chr(13) || chr(10)
    || array_to_string(list_transform(regexp_extract_all(payload, '(?i)<a\b[^>]*?\bhref=["'']([^"''<>]*)["'']', 1), lambda u: 'outlink: ' || u || chr(13) || chr(10)), '')
    || 'source-header: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'source-header: Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS block
  FROM r
  UNION ALL
  SELECT page_id, target_uri, warc_date, refers_to, 'sha256:' || sha256(payload), 'conversion', 'text/plain; charset=utf-8', {_sql_text("payload")} FROM r
)
SELECT page_id, record_type, {_sql_urn("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, warc_date, payload_digest,
  content_type, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM d
"""
