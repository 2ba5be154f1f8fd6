r"""WARC derivatives: each response gives a linked metadata record and a plain-text conversion record.

Pages become response records (HTTP header block and HTML payload). From each follow a ``metadata`` record (title,
language, links, text statistics) and a ``conversion`` record (text/plain), both with WARC-Refers-To naming the response
and with the response's target, date, content type and payload digest in their headers. Record ids are UUIDs made
from a digest of type, address and payload, so a rerun gives the same ids.

All of it is column expressions on one row: no shuffle. ``write_records`` stores whole records as WARC/1.1 text files
through Spark's text writer, ``read_records`` cuts them apart by Content-Length.

``all_records`` gives the response records and both derivatives as one table, so every WARC-Refers-To names a record of it.
The date of a response comes from the pages' ``date`` column where they have one, else from the caller; pages here have
none, so ``op4_warc`` passes a fixed one.

Results for odd input: null HTML is an empty payload, a null address an empty target; line ends in a target are written as
%0D and %0A, in titles, languages and links as blanks, so that no header or field is broken; a page without a title or
language has empty ones; numeric character references beyond Unicode stay as they are; unclosed tags and scripts stay text from the opening sign on; very long pages are one row; repeated
pages give records with the same ids, once per row; an empty table gives none; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .op3_quality import let
from .shared import read_table

DATE = "2024-01-01T00:00:00Z"
#: Elements whose content is no text, elements that end a line, and named entities with their characters.
HIDDEN = ("script", "style", "noscript", "template")
LINES = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = (
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
    ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)
NUMERIC = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
HREF = "(?i)<a\\s[^>]*?href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
LANG = "(?i)<html[^>]*?\\slang\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"


def _steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order, from HTML to text; the same in Java's and RE2's syntax."""
    hidden = [(f"(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>", " ") for tag in HIDDEN]
    lines = [(f"(?i)</?({LINES})(\\s[^>]*)?/?>", "\n"), ("<[a-zA-Z/!?][^>]*>", "")]
    return [("(?s)<!--.*?-->", ""), *hidden, ("[ \\t\\r\\n\\f]+", " "), *lines]


def _tidy() -> list[tuple[str, str]]:
    return [("[ \\t]+", " "), (" ?\n[ \n]*", "\n"), ("^[ \n]+|[ \n]+$", "")]


def _numeric(text: Column) -> Column:
    """Numeric character references as their characters."""

    def sign(x: Column) -> Column:
        body = F.regexp_replace(x, "^&#|;$", "")
        code = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 9), 16, 10)).otherwise(body).cast("int")
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    found, gaps = F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0)), F.split(text, NUMERIC, -1)
    joined = F.array_join(F.zip_with(gaps, F.transform(found, sign), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return F.when(text.contains("&#"), joined).otherwise(text)


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, "[\r\n]+", " ")


def _unquoted(value: Column) -> Column:
    return _one_line(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def plain_text(html: Column) -> Column:
    for pattern, replacement in _steps():
        html = F.regexp_replace(html, pattern, replacement)
    html = let(html, _numeric)
    for entity, sign in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(sign))
    for pattern, replacement in _tidy():
        html = F.regexp_replace(html, pattern, replacement)
    return html


def _record_id(*parts: Column) -> Column:
    """A UUID URN from the first 128 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target, date, content_type, payload, payload_digest) from (page_id, url, html) and perhaps date."""
    html, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("html", "url"))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.lit(date)
    if "date" in pages.columns:
        told = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'") if pages.schema["date"].dataType.simpleString().startswith(("timestamp", "date")) else F.col("date").cast("string")
        when = F.coalesce(_one_line(told), when)
    rows = pages.select("page_id", url.alias("target"), when.alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), html.alias("payload"))
    rows = rows.withColumn("payload_digest", _digest(F.col("payload")))
    return rows.withColumn("record_id", _record_id(F.lit("response"), F.col("target"), F.col("payload_digest")))


def _header(*fields: tuple[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields]
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines)


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows per response: (page_id, warc_type, record_id, refers_to, target, date, block_digest, source_digest, header, block)."""
    links = F.transform(F.regexp_extract_all("payload", F.lit(HREF), F.lit(1)), _unquoted)
    title = F.regexp_extract("payload", "(?is)<title[^>]*>(.*?)</title", 1)
    lang = _unquoted(F.regexp_extract("payload", LANG, 1))

    def fields(text: Column) -> Column:
        about = F.concat_ws(
            "\r\n", F.concat(F.lit("title: "), _one_line(plain_text(title))), F.concat(F.lit("language: "), lang),
            F.concat(F.lit("text-length: "), F.octet_length(text).cast("string")),
            F.concat(F.lit("outlinks: "), F.size(links).cast("string")),
            F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)), "\r\n"),
        )
        return F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("kind"), about.alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("kind"), text.alias("block")),
        )

    both = F.explode(let(plain_text(F.col("payload")), fields)).alias("x")
    source = [F.col(c) for c in ("page_id", "target", "date", "content_type", "payload_digest")]
    rows = found.select(*source, F.col("record_id").alias("refers_to"), both).select("*", "x.*").drop("x")
    rows = rows.withColumn("block_digest", _digest(F.col("block")))
    rows = rows.withColumn("record_id", _record_id(F.col("warc_type"), F.col("target"), F.col("refers_to"), F.col("block_digest")))
    header = _header(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("X-Source-Content-Type", F.col("content_type")), ("X-Source-Payload-Digest", F.col("payload_digest")),
        ("Content-Type", F.col("kind")), ("Content-Length", F.octet_length("block")),
    )
    return rows.select(
        "page_id", "warc_type", "record_id", "refers_to", "target", "date", "block_digest",
        F.col("payload_digest").alias("source_digest"), header.alias("header"), "block",
    )


def all_records(found: DataFrame) -> DataFrame:
    """Responses and derivatives as one table with the columns of ``derivatives``; a response refers to none."""
    return response_records(found).unionByName(derivatives(found))


def response_records(found: DataFrame) -> DataFrame:
    """The response records themselves, as rows like those of ``derivatives``: an HTTP header block before the payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), F.col("content_type"), F.lit("\r\n\r\n"), F.col("payload"))
    header = _header(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target")),
        ("WARC-Date", F.col("date")), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("block")),
    )
    rows = found.withColumn("block", http).withColumn("block_digest", _digest(F.col("block")))
    return rows.select(
        "page_id", F.lit("response").alias("warc_type"), "record_id", F.lit(None).cast("string").alias("refers_to"), "target", "date",
        "block_digest", F.col("payload_digest").alias("source_digest"), header.alias("header"), "block",
    )


def write_records(records: DataFrame, path: str) -> None:
    """Files of records: header, blank line, block, two line ends."""
    whole = records.select(F.concat("header", F.lit("\r\n\r\n"), "block", F.lit("\r\n")).alias("value"))
    whole.write.option("lineSep", "\r\n").text(path)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            headers, blocks, at = [], [], 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                header = data[at:end].decode()
                length = next(int(x.partition(":")[2]) for x in header.split("\r\n") if x.lower().startswith("content-length:"))
                headers.append(header)
                blocks.append(data[end + 4 : end + 4 + length].decode())
                at = end + 4 + length + 4
            yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(blocks, pa.string())], names=["header", "block"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record under a folder."""
    return spark.read.format("binaryFile").load(f"{path}/part-*").select("content").mapInArrow(_cut, "header string, block string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_records(responses(read_table(spark, sf_dir, "pages")))


def _sql_text(html: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, replacement in _steps():
        new = "chr(10)" if replacement == "\n" else quoted(replacement)
        html = f"regexp_replace({html}, {quoted(pattern)}, {new}, 'g')"
    body = "regexp_replace(x, '^&#|;$', '', 'g')"
    code = f"case when lower({body})[1] = 'x' then ('0x' || {body}[2:])::integer else {body}::integer end"
    sign = f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr({code}) else x end"
    found = f"list_transform(regexp_extract_all({html}, '{NUMERIC}'), lambda x: {sign})"
    gaps = f"string_split_regex({html}, '{NUMERIC}')"
    html = f"array_to_string(list_transform({gaps}, lambda g, i: g || coalesce({found}[i], '')), '')"
    for entity, sign in ENTITIES:
        html = f"replace({html}, {quoted(entity)}, {quoted(sign)})"
    for pattern, replacement in _tidy():
        new = "chr(10)" if replacement == "\n" else quoted(replacement)
        html = f"regexp_replace({html}, {quoted(pattern).replace(chr(10), '\\n')}, {new}, 'g')"
    return html


def _sql_id(*parts: str) -> str:
    digest = f"sha256(concat_ws(chr(10), {', '.join(parts)}))"
    cut = ", ".join(f"substring({digest}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cut}) || '>'"


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_sql_line = lambda x: f"regexp_replace({x}, '[\\r\\n]+', ' ', 'g')"
_SQL_BARE = """regexp_replace({}, '^["'']|["'']$', '', 'g')"""

ORACLE = f"""
with r as (
  select page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') target, '{DATE}' date, 'text/html; charset=utf-8' content_type, coalesce(html, '') payload
  from pages),
d as (select *, 'sha256:' || sha256(payload) payload_digest from r),
i as (select *, {_sql_id("'response'", "target", "payload_digest")} refers_to, {_sql_text("payload")} txt,
  {_sql_line(_sql_text("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)"))} title,
  {_sql_line(_SQL_BARE.format(f"regexp_extract(payload, {_quoted(LANG)}, 1)"))} lang,
  list_transform(regexp_extract_all(payload, {_quoted(HREF)}, 1), lambda x: {_sql_line(_SQL_BARE.format("x"))}) links from d),
b as (
  select *, 'conversion' warc_type, 'text/plain; charset=utf-8' kind, txt block from i
  union all
  select *, 'metadata', 'application/warc-fields', concat_ws(chr(13) || chr(10), 'title: ' || title, 'language: ' || lang,
    'text-length: ' || strlen(txt), 'outlinks: ' || len(links),
    coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x), chr(13) || chr(10)), '')) from i),
g as (select *, 'sha256:' || sha256(block) block_digest from b),
n as (select *, {_sql_id("warc_type", "target", "refers_to", "block_digest")} record_id from g)
select page_id, warc_type, record_id, refers_to, target, date, block_digest, payload_digest source_digest,
  concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to,
    'WARC-Target-URI: ' || target, 'WARC-Date: ' || date, 'WARC-Block-Digest: ' || block_digest,
    'X-Source-Content-Type: ' || content_type, 'X-Source-Payload-Digest: ' || payload_digest, 'Content-Type: ' || kind,
    'Content-Length: ' || strlen(block)) header, block
from n
union all
select page_id, 'response', refers_to, null, target, date, 'sha256:' || sha256(block), payload_digest,
  concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: response', 'WARC-Record-ID: ' || refers_to, 'WARC-Target-URI: ' || target,
    'WARC-Date: ' || date, 'WARC-Payload-Digest: ' || payload_digest, 'WARC-Block-Digest: sha256:' || sha256(block),
    'Content-Type: application/http; msgtype=response', 'Content-Length: ' || strlen(block)), block
from (select *, concat_ws(chr(13) || chr(10), 'HTTP/1.1 200 OK', 'Content-Type: ' || content_type, '', payload) block from i)
"""
