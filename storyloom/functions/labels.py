"""Label tokens and the guard against false merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.constants import GENERIC_EVENT_TOKENS, LABEL_STOPWORDS, LABEL_TOKEN_ALIASES
from storyloom.functions.text import clean, text_or_empty


def _words(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def label_tokens(label: Column | str, aliases: dict[str, str] = LABEL_TOKEN_ALIASES) -> Column:
    """Distinct lower-case words of two or more letters or digits, aliases applied."""
    words = F.regexp_extract_all(F.lower(text_or_empty(label)), F.lit("[a-z0-9]+"), F.lit(0))
    words = F.filter(words, lambda w: F.length(w) > 1)

    def resolve(word: Column) -> Column:
        out = word
        for alias, target in aliases.items():
            out = F.when(word == alias, F.lit(target)).otherwise(out)
        return out

    return F.array_distinct(F.transform(words, resolve))


def distinctive_tokens(
    label: Column | str,
    generic: list[str] = GENERIC_EVENT_TOKENS,
    stopwords: list[str] = LABEL_STOPWORDS,
    aliases: dict[str, str] = LABEL_TOKEN_ALIASES,
) -> Column:
    return F.array_except(label_tokens(label, aliases), _words(stopwords + generic))


def is_generic_label(
    label: Column | str,
    generic: list[str] = GENERIC_EVENT_TOKENS,
    aliases: dict[str, str] = LABEL_TOKEN_ALIASES,
) -> Column:
    """True when the label names a kind of event (crash, trial, ...)."""
    return F.arrays_overlap(label_tokens(label, aliases), _words(generic))


def label_key(label: Column | str) -> Column:
    return F.lower(clean(label))


def may_be_same_story(
    left: Column | str,
    right: Column | str,
    generic: list[str] = GENERIC_EVENT_TOKENS,
    stopwords: list[str] = LABEL_STOPWORDS,
    aliases: dict[str, str] = LABEL_TOKEN_ALIASES,
) -> Column:
    """Two labels of generic events need a distinctive word in common."""
    both_generic = is_generic_label(left, generic, aliases) & is_generic_label(
        right, generic, aliases
    )
    shared = F.arrays_overlap(
        distinctive_tokens(left, generic, stopwords, aliases),
        distinctive_tokens(right, generic, stopwords, aliases),
    )
    return (label_key(left) == label_key(right)) | ~both_generic | shared
