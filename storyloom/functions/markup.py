"""Main text of a page, with built-in expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.constants import SKIP_TAGS
from storyloom.functions.text import strip, text_or_empty

_RAW_TAGS = ("script", "style", "noscript")
_CUT = "\x01"


def _from_code(code: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    units = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, F.decode(units, "UTF-32"))


def unescape(text: Column) -> Column:
    """Replace named and numeric character references that end in a semicolon."""
    names = F.create_map(
        *[F.lit(v) for name, code in name2codepoint.items() for v in (name, chr(code))],
        F.lit("apos"), F.lit("'"),
    )
    pieces = F.split(text, "&")

    def restore(piece: Column) -> Column:
        ref = F.regexp_extract(
            piece, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,30});", 1
        )
        char = (
            F.when(ref == "", F.lit(None))
            .when(ref.rlike("^#[xX]"), _from_code(F.conv(F.substring(ref, 3, 6), 16, 10).try_cast("int")))
            .when(F.startswith(ref, F.lit("#")), _from_code(F.substring(ref, 2, 7).try_cast("int")))
            .otherwise(F.element_at(names, ref))
        )
        rest = F.substr(piece, F.length(ref) + 2)
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), restore)
    decoded = F.concat(pieces[0], F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def main_text(html: Column | str, skip_tags: list[str] = SKIP_TAGS) -> Column:
    """Text of the first ``<article>``, else of ``<main>``, else empty.

    Text pieces are joined by line breaks. Expects article markup that is not
    nested in itself; ``sources.pages.page_text`` has a parser for the rest.
    """
    text = text_or_empty(html)
    raw = [t for t in _RAW_TAGS if t in skip_tags]
    blocks = [t for t in skip_tags if t not in _RAW_TAGS]
    for tag in raw:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", _CUT)
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", _CUT)
    for tag in blocks:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", _CUT)

    def body(tag: str) -> Column:
        found = F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)", 1)
        return F.when(text.rlike(rf"(?is)<{tag}\b[^>]*>"), found)

    kept = F.coalesce(body("article"), body("main"), F.lit(""))
    kept = F.regexp_replace(kept, "<[^>]*>", _CUT)
    kept = F.regexp_replace(kept, f"{_CUT}+", "\n")
    return strip(F.regexp_replace(unescape(kept), "\n{3,}", "\n\n"))
