"""HTML to text as one regular expression that cuts the page into pieces and one expression a piece."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

SKIPPED = ("script", "style", "noscript", "svg")
BLOCKS = ("p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "article", "section", "header", "footer")
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™",
    "mdash": "—", "ndash": "–", "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"', "hellip": "…", "bull": "•",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
}


def _skipped(tag: str) -> str:
    return rf"(?i:<{tag}(?:[^A-Za-z0-9>/]|[^A-Za-z0-9>][^>]*[^>/])?>[\s\S]*?(?:</{tag}>|\z))"


ENTITY = r"&[A-Za-z]{2,6};|&#\+?[0-9]{1,10};|&#[xX]\+?[0-9A-Fa-f]{1,9};"
PIECE = "|".join([r"<!--(?:>|->|[\s\S]*?-->)", *map(_skipped, SKIPPED), "<[^>]*>", ENTITY, "[^<&]+", "[<&]"])
BLOCK = rf"(?i)^<({'|'.join(BLOCKS)})([^A-Za-z0-9][\s\S]*)?>$"
MARKUP = r"\A<[\s\S]+\z"  # a piece of a lone < is text


def entity(piece: Column) -> Column:
    """The character of an entity; null if it is none that is known."""
    names = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (f"&{k};", v)])
    decimal = F.regexp_extract(piece, r"^&#\+?([0-9]{1,10});$", 1).try_cast("bigint")
    digits = F.regexp_extract(piece, r"^&#[xX]\+?([0-9A-Fa-f]{1,9});$", 1)
    number = F.coalesce(decimal, F.when(digits != "", F.conv(digits, 16, 10).cast("bigint")))
    valid = number.between(0, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.coalesce(F.element_at(names, piece), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))


def _pieces(html: Column, turn) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), turn), "")


def strip_html(html: Column) -> Column:
    """Text of a page: comments, tags and the content of scripts and styles go, entities are decoded, block tags part words."""

    def turn(piece):
        return F.when(piece.rlike(BLOCK), " ").when(piece.rlike(MARKUP), "").when(piece.rlike(r"\A&[\s\S]+;\z"), F.coalesce(entity(piece), piece)).otherwise(piece)

    return squeeze(_pieces(html, turn))


def decode_entities(text: Column) -> Column:
    """Known entities become characters, all else stays."""
    parts = F.regexp_extract_all(text, F.lit(f"{ENTITY}|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A&[\s\S]+;\z"), F.coalesce(entity(p), p)).otherwise(p)), "")
