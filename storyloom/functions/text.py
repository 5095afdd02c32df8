"""Text columns: cleaning, hashing and normalisation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separator controls.
SPACE_CHARS = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_NOT_BLANK_CHAR = (
    r"\t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[ {_NOT_BLANK_CHAR}]"
# What has to change to get single blanks: longer runs, and other white space.
_UNEVEN_SPACE = f"{SPACE}{{2,}}|[{_NOT_BLANK_CHAR}]"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(as_col(value), F.lit(""))


def strip(value: Column | str) -> Column:
    """Drop white space of any kind at both ends (``trim`` drops spaces only)."""
    return F.btrim(as_col(value), F.lit(SPACE_CHARS))


def clean(value: Column | str) -> Column:
    return strip(text_or_empty(value))


def is_blank(value: Column | str) -> Column:
    return clean(value) == ""


def non_blank(value: Column | str) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(clean(value), F.lit(""))


def collapse_spaces(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(value), _UNEVEN_SPACE, " "))


def fold(value: Column | str) -> Column:
    """Lower case with single spaces; the form evidence and places are matched in."""
    return F.lower(collapse_spaces(value))


def strip_tags(value: Column | str) -> Column:
    return strip(F.regexp_replace(text_or_empty(value), "<[^>]+>", " "))


def content_hash(title: Column | str, description: Column | str) -> Column:
    """Hash that decides whether a stored label still fits an article."""
    return F.sha2(
        F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(description)), 256
    )


def claim_input(title: Column | str, description: Column | str) -> Column:
    """Text that claims are read from: title, blank line, description without tags."""
    return strip(F.concat(clean(title), F.lit("\n\n"), strip_tags(description)))


def claim_input_hash(content: Column | str) -> Column:
    return F.sha2(as_col(content), 256)


def evidence_in(span: Column | str, content: Column | str) -> Column:
    """True when the non-empty folded span occurs in the folded content."""
    needle = fold(span)
    return (needle != "") & F.contains(fold(content), needle)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs; give a stored column, the text is read per phrase."""
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))
