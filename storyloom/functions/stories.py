"""Story-grain predicates, scores and trends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.constants import (
    DEFAULT_MOVEMENT_TAG,
    EDITION_REMAINDER,
    EDITION_SECTIONS,
    IMPORTANCE_WEIGHT,
    LEAD_EXCLUDED_THEMES,
    LOW_INTEREST_KEYWORDS,
    LOW_INTEREST_LEAD_THEMES,
    MOVEMENT_TAGS,
    POLITICS_THEMES,
    SECTION_EXCLUDED_THEMES,
    SOURCE_WEIGHT,
    THEMES,
    TREND_SCORES,
)
from storyloom.functions.text import as_col, contains_any, text_or_empty


def choose(key: Column | str, mapping: dict, default=None) -> Column:
    """``mapping[key]`` as a CASE expression."""
    out = F.lit(default)
    for value, result in reversed(list(mapping.items())):
        out = F.when(as_col(key) == value, F.lit(result)).otherwise(out)
    return out


def has_any_theme(themes: Column | str, wanted: list[str]) -> Column:
    return F.arrays_overlap(as_col(themes), F.array(*[F.lit(t) for t in wanted]))


def trend(count: Column | str, previous: Column | str) -> Column:
    """Coverage against the latest earlier day: new, up, down or steady."""
    change = as_col(count) - as_col(previous)
    return (
        F.when(as_col(previous).isNull(), F.lit("new"))
        .when(change > 1, F.lit("up"))
        .when(change < -1, F.lit("down"))
        .otherwise(F.lit("steady"))
    )


_TRENDS = ["new", "up", "steady", "down"]


def trend_code(trend_label: Column | str = "trend") -> Column:
    """Trend as a small number; null for anything else."""
    return choose(trend_label, {name: i for i, name in enumerate(_TRENDS)})


def trend_name(code: Column | str) -> Column:
    return choose(code, {i: name for i, name in enumerate(_TRENDS)})


def score(
    importance: Column | str = "importance_avg",
    sources: Column | str = "source_count",
    trend_label: Column | str = "trend",
) -> Column:
    """Importance leads; broad pickup and movement add to it."""
    return (
        as_col(importance) * IMPORTANCE_WEIGHT
        + as_col(sources) * SOURCE_WEIGHT
        + choose(trend_label, TREND_SCORES, 0)
    )


def interest_text(*texts: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *[text_or_empty(t) for t in texts]))


def mentions_low_interest(
    text: Column | str, keywords: list[str] = LOW_INTEREST_KEYWORDS
) -> Column:
    """Plain substring test on an ``interest_text`` column."""
    return contains_any(as_col(text), keywords)


def is_lead() -> Column:
    niche = has_any_theme("themes", LOW_INTEREST_LEAD_THEMES)
    strong = (F.col("importance_avg") >= 4.5) & (F.col("source_count") >= 3)
    return (
        ~has_any_theme("themes", LEAD_EXCLUDED_THEMES)
        & ~F.col("low_interest")
        & (~niche | strong)
    )


def _may_fill_section() -> Column:
    return ~has_any_theme("themes", SECTION_EXCLUDED_THEMES)


def is_politics() -> Column:
    return _may_fill_section() & has_any_theme("themes", POLITICS_THEMES)


def is_economy() -> Column:
    return _may_fill_section() & F.array_contains("themes", "Economy")


def is_other_important() -> Column:
    weight = (F.col("importance_avg") >= 2.5) | (F.col("source_count") >= 2)
    return (
        _may_fill_section()
        & F.array_contains("themes", "Other")
        & ~F.col("low_interest")
        & weight
    )


def theme_summary(
    themes: Column | str, primary: Column | str | None = None, order: list[str] = THEMES
) -> Column:
    """Themes in list order; the primary theme stands in when none is listed."""
    listed = F.filter(
        F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains(as_col(themes), t)
    )
    text = F.array_join(listed, " / ")
    if primary is None:
        return text
    return F.when(F.size(listed) > 0, text).otherwise(as_col(primary))


def movement_tag(trend_label: Column | str = "trend") -> Column:
    return choose(trend_label, MOVEMENT_TAGS, DEFAULT_MOVEMENT_TAG)


def edition_rank(trend_label: Column | str = "trend") -> Column:
    """Section number by movement; a missing trend counts as steady."""
    known = F.coalesce(as_col(trend_label), F.lit("steady"))
    ranks = {name: i + 1 for i, (name, _, _) in enumerate(EDITION_SECTIONS)}
    return choose(known, ranks, len(EDITION_SECTIONS) + 1)


def edition_title(rank: Column | str) -> Column:
    titles = {i + 1: title for i, (_, title, _) in enumerate(EDITION_SECTIONS)}
    return choose(rank, titles, EDITION_REMAINDER[0])


def edition_description(rank: Column | str) -> Column:
    texts = {i + 1: text for i, (_, _, text) in enumerate(EDITION_SECTIONS)}
    return choose(rank, texts, EDITION_REMAINDER[1])
