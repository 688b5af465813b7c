"""WARC derivatives: metadata and plain-text conversion records of response records.

Everything is a column expression, so records flow through one stage without a shuffle, however large the crawl is.
Identifiers are name-based (from the source record's identifier), so a repeated run gives the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"

# Markup whose content is no text, markup that breaks a line, and named character references.
HIDDEN = r"(?is)<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<title\b.*?</title[^>]*>|<!--.*?-->|<![a-z][^>]*>"
BREAKS = r"(?i)</?(p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|thead|tbody|article|section|header|footer|nav|main|aside|body|html|head|blockquote|pre|form|figure)\b[^>]*>"
TAGS = r"</?[A-Za-z][^>]*>"
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
              ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _urn(*parts: Column) -> Column:
    """urn:uuid of the digest of the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def _numeric(text: Column) -> Column:
    """Decimal and hexadecimal character references as characters; those that name no character stay."""
    def one(part):
        name = F.regexp_extract(part, r"^([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1)
        code = F.when(F.lower(F.substring(name, 1, 1)) == "x", F.conv(F.substring(name, 2, 9), 16, 10)).when(name != "", name).cast("int")
        fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(fits, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.substring(part, F.length(name) + 2, F.length(part)))
                      ).otherwise(F.concat(F.lit("&#"), part))
    parts = F.split(text, "&#")
    return F.when(text.contains("&#"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))).otherwise(text)


def plain_text(html: Column) -> Column:
    """Text of a page: without hidden parts, a line for each block, references as characters, spaces collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAKS, "\n")
    text = _numeric(F.regexp_replace(text, TAGS, ""))
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of `pages` (page_id, url, html): page_id, record_id, target_uri, warc_date, http_header, payload,
    block_digest, payload_digest. A null page is an empty payload; a null url an unknown target. `date` is the crawl's."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                      F.octet_length(payload).cast("string"), F.lit(CRLF))
    return (pages.select("page_id", _urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").cast("string").alias("target_uri"),
                         F.lit(date).alias("warc_date"), header.alias("http_header"), payload.alias("payload"))
            .withColumn("block_digest", _digest(F.concat("http_header", F.lit(CRLF), "payload"))).withColumn("payload_digest", _digest(F.col("payload"))))


def derivatives(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response of `source`, with the columns of `responses`.

    Columns: page_id, warc_type, record_id, refers_to (the response's identifier), target_uri and warc_date (the
    response's), content_type, content_length (bytes), block, block_digest, source_digest (the response's payload
    digest). The metadata block lists the response's digests and HTTP header, the title and language of the page and
    the conversion's identifier and digest; the conversion block is the page's text. An empty payload has an empty
    conversion. Repeated responses give equal records; columns beyond those of `responses` are not read.
    """
    made = source.select(
        "page_id", "record_id", "target_uri", "warc_date", "http_header", "block_digest", "payload_digest", plain_text(F.col("payload")).alias("text"),
        F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title", 1), r"[ \t\r\n\f]+", " ")).alias("title"),
        F.regexp_extract("payload", r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z-]+)""", 1).alias("language"))
    made = made.withColumn("text_digest", _digest(F.col("text")))
    conversion = _urn(F.lit("conversion"), F.col("record_id"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    block = F.concat(field("source-block-digest", F.col("block_digest")), field("source-payload-digest", F.col("payload_digest")),
                     field("conversion-record-id", conversion), field("conversion-block-digest", F.col("text_digest")),
                     field("language", F.col("language")), field("title", F.col("title")), F.lit("source-http-header:" + CRLF), F.col("http_header"))
    made = made.withColumn("meta", block).withColumn("conversion_id", conversion)
    record = lambda kind, ident, mime, body, digest: F.struct(
        F.lit(kind).alias("warc_type"), ident.alias("record_id"), F.lit(mime).alias("content_type"), F.octet_length(body).cast("long").alias("content_length"),
        body.alias("block"), digest.alias("block_digest"))
    both = F.array(record("metadata", _urn(F.lit("metadata"), F.col("record_id")), "application/warc-fields", F.col("meta"), _digest(F.col("meta"))),
                   record("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text"), F.col("text_digest")))
    rows = made.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("payload_digest").alias("source_digest"), F.explode(both).alias("r"))
    return rows.select("page_id", "r.warc_type", "r.record_id", "refers_to", "target_uri", "warc_date", "r.content_type", "r.content_length", "r.block", "r.block_digest", "source_digest")


def serialized(records: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of each record of `derivatives`, header lines, empty line, block and record end."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
             ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    text = F.concat(F.lit("WARC/1.1" + CRLF), *[line(n, F.col(c)) for n, c in names], F.lit(CRLF), F.col("block"), F.lit(CRLF * 2))
    return records.select("page_id", F.encode(text, "UTF-8").alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """(page_id, headers map, block) of serialized records: the inverse of `serialized`."""
    text = F.decode("record", "UTF-8")
    cut = F.locate(CRLF * 2, text)
    head = F.split(F.substring(text, F.lit(1), cut - 1), CRLF)
    lines = F.slice(head, 2, F.size(head) - 1)
    return records.select("page_id", F.map_from_arrays(F.transform(lines, lambda x: F.substring_index(x, ": ", 1)), F.transform(lines, lambda x: F.substring(x, F.locate(": ", x) + 2, F.length(x)))).alias("headers"),
                          F.substring(text, cut + 4, F.length(text) - cut - 7).alias("block"))
