"""HTML to article text and title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrobora.functions.text import let

# Elements removed before tags are stripped, and entities decoded afterwards, in these orders.
FURNITURE = ["script", "style", "noscript", "nav", "header", "footer", "aside"]
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
]
# At most seven decimal or six hexadecimal digits reach every code point.
NUMBER_REFERENCE = "&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
MIN_ARTICLE_CHARS = 120


def _decode_numbers(c: Column) -> Column:
    """Decimal and hexadecimal character references as their characters; impossible numbers stay as written."""
    return let(c, _numbers_decoded)


def _numbers_decoded(c: Column) -> Column:
    between = F.split(c, NUMBER_REFERENCE, -1)
    written = F.regexp_extract_all(c, F.lit(NUMBER_REFERENCE), 0)

    def character(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);$", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        # UTF-32 spells any code point in four bytes.
        text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(F.coalesce(sound, F.lit(False)), text).otherwise(ref)

    parts = F.transform(written, lambda ref, i: F.concat(F.get(between, i), character(ref)))
    decoded = F.concat(F.array_join(parts, ""), F.element_at(between, -1))
    return F.when(F.contains(c, F.lit("&#")), decoded).otherwise(c)


def decode_entities(c: Column) -> Column:
    c = _decode_numbers(c)
    for pattern, replacement in ENTITIES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip_tags(c: Column) -> Column:
    """Text without tags, entities decoded, white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(c, "<[^>]+>", " ")), r"\s+", " "))


def html_to_text(c: Column, max_chars: int | None = None) -> Column:
    """Article text of a page; null when fewer than 120 characters remain.

    The whole text is kept unless ``max_chars`` is given.
    """
    body = c
    for tag in FURNITURE:
        body = F.regexp_replace(body, rf"(?is)<{tag}.*?</{tag}>", " ")
    article = F.regexp_extract(body, r"(?is)<article.*?</article>", 0)
    text = strip_tags(let(F.struct(body.alias("body"), article.alias("article")), lambda p: F.when(
        p["article"] != "", p["article"]).otherwise(p["body"])))
    kept = let(text, lambda t: F.when(F.length(t) >= MIN_ARTICLE_CHARS, t))
    return kept if max_chars is None else F.substring(kept, 1, max_chars)


def tag_text(c: Column, tag: str) -> Column:
    """Decoded content of the first ``tag`` element."""
    raw = F.regexp_extract(c, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    raw = F.regexp_replace(raw, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.trim(decode_entities(raw))


def html_title(c: Column) -> Column:
    """Page title without a trailing publisher name."""
    title = tag_text(c, "title")
    cut = F.trim(F.regexp_replace(title, r"\s+-\s+[^-]{2,40}$", ""))
    return F.when(cut != "", cut).otherwise(title)
