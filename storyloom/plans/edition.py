"""Displayed stories regrouped by movement, as rows of the daily edition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.constants import GAZETTEER
from storyloom.functions.dates import utc_minutes
from storyloom.functions.render import edition_meta, source_summary, story_body
from storyloom.functions.stories import edition_description, movement_tag
from storyloom.operators.locations import story_locations
from storyloom.operators.rollup import top_sources
from storyloom.operators.sections import edition_sections
from storyloom.session import cut

_USED = ["canonical_label", "title", "description", "theme", "source", "ordinal"]


def edition_rows(filled: DataFrame, tracked: DataFrame, gazetteer=GAZETTEER) -> DataFrame:
    """Tag, meta line, body, sources and location of every displayed story."""
    shown = cut(edition_sections(filled))
    labels = F.broadcast(shown.select("canonical_label"))
    # Written once: places, sources and their counts all read the few stories shown.
    articles = cut(tracked.join(labels, "canonical_label", "left_semi").select(*_USED))
    latest = F.coalesce(
        utc_minutes("latest_reported"), F.col("first_published_at"), F.lit("unknown time")
    )
    return (
        shown.join(story_locations(articles, gazetteer), "canonical_label", "left")
        .join(top_sources(articles), "canonical_label", "left")
        .select(
            "edition_rank",
            "edition_title",
            edition_description("edition_rank").alias("edition_description"),
            "section_rank",
            "rank",
            "canonical_label",
            movement_tag("trend").alias("tag"),
            edition_meta(
                "location.label", "themes", "theme", "importance_avg", "source_count", latest
            ).alias("meta"),
            story_body(
                "delta", "trend", "previous_context.summary", "briefing", "source_count", latest
            ).alias("body"),
            source_summary("top_sources", "distinct_sources").alias("sources"),
            "location",
        )
    )


def edition_counts(rows: DataFrame) -> DataFrame:
    """Stories per edition section; empty sections do not appear."""
    return rows.groupBy("edition_rank", "edition_title").agg(F.count("*").alias("stories"))
