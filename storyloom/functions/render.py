"""Report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.constants import FALLBACK_DELTAS, TREND_ICONS, TREND_WORDS
from storyloom.functions.dates import utc_minutes
from storyloom.functions.stories import choose, theme_summary
from storyloom.functions.text import SPACE, as_col, clean, collapse_spaces, non_blank

CONTEXT_WORD_LIMIT = 34


def one_decimal(value: Column | str) -> Column:
    return F.round(as_col(value), 1).cast("decimal(20,1)").cast("string")


def _plural(count: Column, zero_is_plural: bool) -> Column:
    many = count != 1 if zero_is_plural else count > 1
    return F.when(many, F.lit("sources")).otherwise(F.lit("source"))


def source_line(source, reported, title, url) -> Column:
    """``- source — reported time — [title](url)``, without the link when there is no url."""
    shown = F.coalesce(as_col(title), F.lit("Untitled"))
    linked = F.concat(F.lit("["), shown, F.lit("]("), as_col(url), F.lit(")"))
    return F.concat(
        F.lit("- "), as_col(source), F.lit(" — reported "), as_col(reported), F.lit(" — "),
        F.when(F.coalesce(as_col(url), F.lit("")) != "", linked).otherwise(shown),
    )


def evidence_line(claim_type, source, url, span, confidence) -> Column:
    name = F.coalesce(F.nullif(as_col(source), F.lit("")), F.lit("Unknown source"))
    linked = F.concat(F.lit("["), name, F.lit("]("), as_col(url), F.lit(")"))
    reference = F.when(F.coalesce(as_col(url), F.lit("")) != "", linked).otherwise(name)
    # A missing or zero confidence is shown as one half.
    shown = F.coalesce(F.nullif(as_col(confidence), F.lit(0.0)), F.lit(0.5))
    return F.concat(
        F.lit("- `"), as_col(claim_type), F.lit("` — "), reference, F.lit(' — "'), as_col(span),
        F.lit('" _('), (shown * 100).cast("int").cast("string"), F.lit("%)_"),
    )


def headline(rank, trend, label) -> Column:
    return F.concat(
        F.lit("## "), as_col(rank).cast("string"), F.lit(". "),
        choose(trend, TREND_WORDS, ""), F.lit(" "), as_col(label),
    )


def latest_text(latest: Column | str) -> Column:
    return F.coalesce(utc_minutes(latest), F.lit("unknown time"))


def story_meta(themes, importance, sources, latest) -> Column:
    return F.concat(
        F.lit("_"), theme_summary(themes), F.lit(" — importance "), one_decimal(importance),
        F.lit(" — "), as_col(sources).cast("string"), F.lit(" "), _plural(as_col(sources), False),
        F.lit(" — latest reported "), latest_text(latest), F.lit("_"),
    )


def fallback_delta(has_context: Column, trend: Column | str) -> Column:
    texts = {k: v for k, v in FALLBACK_DELTAS.items() if k in ("up", "down")}
    return F.when(has_context, choose(trend, texts, FALLBACK_DELTAS["other"])).otherwise(
        F.lit(FALLBACK_DELTAS[None])
    )


def fallback_briefing(label, sources, latest, lead_source, lead_title) -> Column:
    title = F.coalesce(F.nullif(as_col(lead_title), F.lit("")), as_col(label))
    return F.concat(
        as_col(label), F.lit(" is included based on "), as_col(sources).cast("string"),
        F.lit(" "), _plural(as_col(sources), False), F.lit(", with the latest report at "),
        latest_text(latest), F.lit(". The lead item is from "),
        F.coalesce(as_col(lead_source), F.lit("A source")), F.lit(": "), title, F.lit("."),
    )


def digest_headline(trend, label, max_importance) -> Column:
    return F.concat(
        F.lit("### "), choose(trend, TREND_ICONS, ""), F.lit(" "), as_col(label),
        F.lit(" _(importance "), as_col(max_importance).cast("string"), F.lit(")_"),
    )


def context_line(summary: Column | str) -> Column:
    """First sentence of an earlier summary, at most 34 words, own labels removed."""
    text = F.regexp_replace(
        clean(summary), rf"(?i)^(?:(?:previously|earlier):{SPACE}*)+", ""
    )
    sentence = F.regexp_extract(collapse_spaces(text), r"^[^.?!]*[.?!]?", 0)
    words = F.split(sentence, " ")
    short = F.regexp_replace(
        F.array_join(F.slice(words, 1, CONTEXT_WORD_LIMIT), " "), "[ ,;:.]+$", ""
    )
    return F.when(
        F.size(words) > CONTEXT_WORD_LIMIT, F.concat(short, F.lit("..."))
    ).otherwise(clean(sentence))


def story_body(delta, trend, summary, briefing, sources, latest) -> Column:
    """What changed, what was known before (not for new stories), then the text."""
    changed = F.concat(F.lit("What changed today: "), non_blank(delta))
    before = F.when(
        ~as_col(trend).eqNullSafe("new"),
        F.concat(F.lit("Previously: "), F.nullif(context_line(summary), F.lit(""))),
    )
    fallback = F.concat(
        F.lit("This story is included based on "), as_col(sources).cast("string"), F.lit(" "),
        _plural(as_col(sources), True), F.lit(", with the latest report at "), as_col(latest),
        F.lit(". A generated briefing was not available."),
    )
    text = F.coalesce(F.nullif(as_col(briefing), F.lit("")), fallback)
    return clean(F.concat_ws("\n\n", changed, before, text))


def edition_meta(place_label, themes, primary_theme, importance, sources, latest) -> Column:
    return F.concat_ws(
        " | ",
        as_col(place_label),
        theme_summary(themes, primary_theme),
        F.concat(F.lit("importance "), one_decimal(importance)),
        F.concat(as_col(sources).cast("string"), F.lit(" "), _plural(as_col(sources), True)),
        F.concat(F.lit("latest "), as_col(latest)),
    )


def source_summary(top_sources: Column | str, distinct: Column | str, shown: int = 5) -> Column:
    listed = F.concat(
        F.lit("Sources: "), F.array_join(as_col(top_sources), ", "),
        F.when(
            as_col(distinct) > shown,
            F.concat(F.lit(" +"), (as_col(distinct) - shown).cast("string")),
        ).otherwise(F.lit("")),
    )
    return F.when(as_col(distinct) > 0, listed).otherwise(F.lit("Sources: none"))
