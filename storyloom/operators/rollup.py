"""Articles -> stories for the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.constants import DEFAULT_THEME, LOW_INTEREST_KEYWORDS, THEMES
from storyloom.functions.stories import (
    interest_text,
    mentions_low_interest,
    score,
    trend_code,
    trend_name,
)
from storyloom.operators.ranking import top_per_group


def _age(moment: str) -> Column:
    """Grows as the moment lies further back."""
    return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - F.col(moment)


def _theme_totals(themes: list[str]) -> list[Column]:
    totals = []
    for i, theme in enumerate(themes):
        hit = F.col("_theme") == theme
        totals.append(F.count_if(hit).alias(f"_count_{i}"))
        totals.append(F.sum(F.when(hit, F.col("importance")).otherwise(0)).alias(f"_weight_{i}"))
    return totals


def _theme_rows(themes: list[str]) -> Column:
    """Themes present, as (count, importance, -rank, theme) so that max() picks the main one."""
    rows = F.array(
        *[
            F.struct(
                F.col(f"_count_{i}").alias("articles"),
                F.col(f"_weight_{i}").alias("weight"),
                F.lit(-i).alias("order"),
                F.lit(theme).alias("theme"),
            )
            for i, theme in enumerate(themes)
        ]
    )
    return F.filter(rows, lambda r: r["articles"] > 0)


def story_rollup(
    tracked: DataFrame,
    order: Column | None = None,
    themes: list[str] = THEMES,
    keywords: list[str] = LOW_INTEREST_KEYWORDS,
    contexts: DataFrame | None = None,
) -> DataFrame:
    """One row per story; the story's articles are never gathered into a row.

    The context of a story is taken from its first article that has one, or from
    ``contexts`` (canonical_label, previous_context) when articles do not carry it.

    ``themes`` is the closed list labels are validated against, so theme totals
    are plain conditional sums next to the other aggregates and everything,
    distinct sources included, is combined map-side first.
    """
    order = F.col("ordinal") if order is None else order
    words = interest_text("canonical_label", "title", "description")
    prepared = tracked.withColumn("_words", words).select(
        "canonical_label",
        "source",
        "importance",
        F.when(F.col("theme").isin(themes), F.col("theme")).otherwise(DEFAULT_THEME).alias("_theme"),
        "reported_ts",
        mentions_low_interest("_words", keywords).alias("_hit"),
        order.alias("_order"),
        F.struct("trend", "story_id").alias("_first"),
        *([] if contexts is not None else ["previous_context"]),
        F.struct("source", "title").alias("_lead"),
        F.col("published_at").alias("_raw"),
        F.when(F.col("observation_id") != 0, F.col("observation_id")).alias("_observation"),
    )
    newest_first = F.struct(
        F.col("reported_ts").isNotNull().alias("dated"), F.col("reported_ts").alias("at")
    )
    context = F.min_by(
        "previous_context", F.when(F.col("previous_context").isNotNull(), F.col("_order"))
    ).alias("previous_context")
    grouped = prepared.groupBy("canonical_label").agg(
        F.min("_order").alias("first_ordinal"),
        F.min_by("_first", "_order").alias("_first"),
        *([] if contexts is not None else [context]),
        F.count_distinct("source").alias("source_count"),
        F.count("*").alias("article_count"),
        F.avg("importance").alias("importance_avg"),
        F.max("reported_ts").alias("latest_reported"),
        # Latest article; among equals the first one, hence the earliest order.
        F.min_by(
            "_lead",
            F.struct(
                F.col("reported_ts").isNull().alias("undated"),
                _age("reported_ts").alias("age"),
                F.col("_order").alias("order"),
            ),
        ).alias("lead"),
        F.min_by("_raw", F.when(F.coalesce("_raw", F.lit("")) != "", F.col("_order"))).alias(
            "first_published_at"
        ),
        F.bool_or("_hit").alias("low_interest"),
        F.array_sort(F.collect_set("_observation")).alias("observation_ids"),
        *_theme_totals(themes),
    )
    if contexts is not None:
        grouped = grouped.join(contexts, "canonical_label", "left")
    return grouped.withColumn("_themes", _theme_rows(themes)).select(
        "canonical_label",
        "first_ordinal",
        F.array_max("_themes")["theme"].alias("theme"),
        F.array_sort(F.transform("_themes", lambda r: r["theme"])).alias("themes"),
        F.coalesce("_first.trend", F.lit("steady")).alias("trend"),
        "source_count",
        "article_count",
        "importance_avg",
        "previous_context",
        "observation_ids",
        F.col("_first.story_id").alias("story_id"),
        "latest_reported",
        "first_published_at",
        "lead",
        "low_interest",
    )


def story_metrics(
    tracked: DataFrame,
    order: Column | None = None,
    themes: list[str] = THEMES,
    keywords: list[str] = LOW_INTEREST_KEYWORDS,
) -> DataFrame:
    """What ranking and sectioning need, for every story.

    All of it is numbers and times, so with a numeric ``order`` the aggregation
    is a compiled hash aggregation and texts of articles are not shuffled.
    ``story_details`` adds the rest for the stories that are shown.
    """
    order = F.col("ordinal") if order is None else order
    words = interest_text("canonical_label", "title", "description")
    theme = F.when(F.col("theme").isin(themes), F.col("theme")).otherwise(DEFAULT_THEME)
    prepared = tracked.withColumn("_words", words).select(
        "canonical_label",
        "source",
        "importance",
        theme.alias("_theme"),
        "reported_ts",
        mentions_low_interest("_words", keywords).alias("_hit"),
        order.alias("_order"),
        trend_code("trend").alias("_trend"),
    )
    grouped = prepared.groupBy("canonical_label").agg(
        F.min("_order").alias("first_ordinal"),
        F.min_by("_trend", "_order").alias("_trend"),
        F.count_distinct("source").alias("source_count"),
        F.count("*").alias("article_count"),
        F.avg("importance").alias("importance_avg"),
        F.max("reported_ts").alias("latest_reported"),
        F.bool_or("_hit").alias("low_interest"),
        *_theme_totals(themes),
    )
    return grouped.withColumn("_themes", _theme_rows(themes)).select(
        "canonical_label",
        "first_ordinal",
        F.array_max("_themes")["theme"].alias("theme"),
        F.array_sort(F.transform("_themes", lambda r: r["theme"])).alias("themes"),
        trend_name("_trend").alias("trend"),
        "source_count",
        "article_count",
        "importance_avg",
        "latest_reported",
        "low_interest",
    )


def story_details(
    tracked: DataFrame,
    shown: DataFrame,
    order: Column | None = None,
    contexts: DataFrame | None = None,
) -> DataFrame:
    """``shown`` stories (few, see ``select_sections``) with the texts of the rollup."""
    labels = F.broadcast(shown.select("canonical_label").distinct())
    articles = tracked.join(labels, "canonical_label", "left_semi")
    details = story_rollup(articles, order, contexts=contexts)
    known = [c for c in shown.columns if c not in ("canonical_label", "trend")]
    return shown.drop("trend").join(details.drop(*known), "canonical_label")


def with_score(stories: DataFrame) -> DataFrame:
    return stories.withColumn("score", score())


def rank_stories(stories: DataFrame) -> DataFrame:
    """Stories by score; equal scores keep the order of their first articles."""
    return with_score(stories).orderBy(F.desc("score"), F.asc("first_ordinal"))


def top_sources(
    articles: DataFrame, keys: list[str] = ["canonical_label"], shown: int = 5
) -> DataFrame:
    """Most frequent sources per story (ties: first to appear) and how many there are."""
    counts = articles.groupBy(*keys, F.coalesce("source", F.lit("Unknown")).alias("source")).agg(
        F.count("*").alias("_articles"), F.min("ordinal").alias("_first")
    )
    distinct = counts.groupBy(*keys).agg(F.count("*").alias("distinct_sources"))
    ranked = top_per_group(counts, keys, [F.desc("_articles"), F.asc("_first")], shown)
    listed = ranked.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda r: r["source"]
        ).alias("top_sources")
    )
    return listed.join(distinct, keys)
