"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A record is a row: its type, identifier, the identifier it refers to, target, date, content type,
length, digests and block.  Records that refer to a response keep its headers and digests, so a
derivative can be traced without the archive it came from.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
# The frequent named character references, with a plain blank for nbsp; the others are looked up in
# the table of HTML, numeric ones are decoded by code point.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©",
    "reg": "®", "middot": "·", "mdash": "—", "ndash": "–", "hellip": "…",
    "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "euro": "€", "bull": "•",
}
DROPPED = "script|style|noscript|template"
# Elements that end a line.
BREAKS = (
    "p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body|blockquote|pre|hr|"
    "html|main|aside|address|search|hgroup|dl|dt|dd|dir|menu|figure|figcaption|caption|colgroup|col|thead|tbody|tfoot|"
    "form|fieldset|legend|option|optgroup|datalist|details|summary|dialog|center|frameset|frame|noframes|"
    "listing|xmp|plaintext"
)
# Cells of a row, and elements that stand between words without ending the line.
BLANKS = (
    "td|th|button|input|select|textarea|meter|progress|img|picture|iframe|object|embed|"
    "audio|video|canvas|svg|map|area|marquee"
)
DATE = "2024-01-01T00:00:00Z"


def record_uuid(kind: str, key: Column) -> Column:
    """A URN that depends on the kind of record and its key alone."""
    h = F.md5(F.concat_ws(":", F.lit(kind), key))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One response record per page.  A null payload is empty, a null URL leaves the target null.

    Pages that share a key share an identifier; a null key counts as the text ``null``.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(CRLF + CRLF),
        payload,
    )
    return pages.select(
        F.col(key).alias("source_key"),
        record_uuid("response", F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("record_id"),
        F.col(url).alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.lit("text/html; charset=utf-8").alias("http_content_type"),
        F.octet_length(block).cast("bigint").alias("content_length"),
        digest(block).alias("block_digest"),
        digest(payload).alias("payload_digest"),
        payload.alias("payload"),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    Generators evaluate their argument without sharing common parts.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _other_entities() -> Column:
    """A constant map of HTML's other named references, from two literals."""
    names = sorted(n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in ENTITIES)
    keys, values = F.lit(" ".join(names)), F.lit("\x1f".join(html5[f"{n};"] for n in names))
    return F.map_from_arrays(F.split(keys, " "), F.split(values, "\x1f"))


def decode_entities(text: Column) -> Column:
    """Named references of HTML, and numeric ones up to the last code point, in one pass.

    References need their semicolon; unknown names stay as they are.
    """
    reference = "#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31}"
    others = _other_entities()

    def character(name: Column) -> Column:
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        number = F.when(hexadecimal, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        number = number.cast("bigint")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        code = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        out = F.when(F.startswith(name, F.lit("#")), code)
        for entity, value in ENTITIES.items():
            out = out.when(name == entity, value)
        return out.otherwise(F.coalesce(F.try_element_at(others, name), F.concat(F.lit("&"), name, F.lit(";"))))

    def one(piece: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        return F.concat(_once(name, character), F.substr(piece, F.length(name) + 2))

    def joined(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

    return _once(F.split(text, f"&(?=(?:{reference});)"), joined)


def _without(html: Column) -> Column:
    """Comments and elements whose content is not text, also unclosed ones, taken out."""
    element = rf"({DROPPED})(?:\s[^>]*)?>.*?(?:</\1\s*>|\z)"
    return F.regexp_replace(html, rf"(?is)<(?:!--.*?(?:-->|\z)|{element})", " ")


def plain_text(html: Column) -> Column:
    """Text of a page, one line per block element, cells apart, blanks folded, empty lines dropped."""
    return _text_of(_without(html))


def _text_of(clean: Column) -> Column:
    text = F.regexp_replace(clean, r"[\t\r\n]+", " ")  # runs of blanks are folded last
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})(?:\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLANKS})(?:\s[^>]*)?/?>", " ")
    text = F.regexp_replace(text, r"<[!/?a-zA-Z][^>]*>", "")
    text = decode_entities(text)
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.btrim(F.regexp_replace(text, r"  +", " "), F.lit(" \n"))


def _fields(clean: Column) -> Column:
    """The warc-fields of a metadata record: title, language, then every link in order.

    ``clean`` is the page after :func:`_without`.
    """
    folded = F.regexp_replace(F.regexp_extract(clean, r"(?is)<title[^>]*>(.*?)</title", 1), r"[ \t\r\n]+", " ")
    title = F.trim(decode_entities(folded))
    language = F.regexp_extract(clean, r"(?is)<html[^>]*\slang=[\"']?([a-zA-Z-]+)", 1)
    value = r"""("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    links = F.regexp_extract_all(clean, F.lit(rf"""(?is)<a\s(?:[^>]*?[\s"'/])?href\s*=\s*{value}"""), F.lit(1))

    def target(found: Column) -> Column:
        """Without the quotes around it, and without line ends, which URLs lose."""
        bare = F.regexp_replace(found, r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.translate(decode_entities(bare), "\r\n", "")

    def lines(found: Column) -> Column:
        first = F.array(
            F.concat(F.lit("title: "), title),
            F.concat(F.lit("language: "), language),
            F.concat(F.lit("outlinks: "), F.size(found).cast("string")),
        )
        return F.concat(first, F.transform(found, lambda x: F.concat(F.lit("outlink: "), target(x))))

    return F.array_join(_once(links, lines), CRLF)


def derive(response: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record of :func:`responses`.

    ``refers_to`` holds the identifier of the response; target, date, HTTP content type and both
    digests of the source go along.  An empty payload gives a conversion record with an empty
    block.  ``header`` is the record's header as text, lines of null fields left out.
    """

    def records(clean: Column) -> Column:
        return F.array(
            F.struct(
                F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"),
                _fields(clean).alias("block"),
            ),
            F.struct(
                F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                _text_of(clean).alias("block"),
            ),
        )

    made = _once(_without(F.col("payload")), records)
    rows = response.select("*", F.explode(made).alias("made")).select(
        "source_key",
        F.col("made.warc_type").alias("warc_type"),
        F.concat(
            F.lit("<urn:uuid:"),
            F.regexp_replace(
                F.md5(F.concat_ws(":", F.col("made.warc_type"), F.col("record_id"))),
                "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5",
            ),
            F.lit(">"),
        ).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("made.content_type").alias("content_type"),
        F.octet_length("made.block").cast("bigint").alias("content_length"),
        digest(F.col("made.block")).alias("block_digest"),
        F.col("http_content_type").alias("source_content_type"),
        F.col("content_length").alias("source_content_length"),
        F.col("block_digest").alias("source_block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("made.block").alias("block"),
    )

    def line(name: str, column: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.col(column).cast("string"))

    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        line("WARC-Type", "warc_type"),
        line("WARC-Record-ID", "record_id"),
        line("WARC-Refers-To", "refers_to"),
        line("WARC-Refers-To-Target-URI", "target_uri"),
        line("WARC-Refers-To-Date", "date"),
        line("WARC-Target-URI", "target_uri"),
        line("WARC-Date", "date"),
        line("WARC-Block-Digest", "block_digest"),
        line("WARC-Source-Content-Type", "source_content_type"),
        line("WARC-Source-Block-Digest", "source_block_digest"),
        line("WARC-Source-Payload-Digest", "source_payload_digest"),
        line("Content-Type", "content_type"),
        line("Content-Length", "content_length"),
    )
    return rows.withColumn("header", F.concat(header, F.lit(CRLF + CRLF)))
