"""Daily coverage of stories and what was known before a day.

Two forms of every look-back: ``..._history`` answers it for every day in the
table at once, the plain form answers it for one run date. Both reduce to one
row per story and day before any ordered step, so the ordered step never sees
more rows per story than there are days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.constants import LOOKBACK_DAYS
from storyloom.functions.stories import trend
from storyloom.functions.text import is_blank, non_blank
from storyloom.operators.ranking import top_per_group

_ARTICLE_FIELDS = ["date", "source", "title", "description", "url", "reported_at"]


def daily_coverage(
    articles: DataFrame, keys: list[str], co_locate: str | None = None
) -> DataFrame:
    """Distinct sources, articles and mean importance per key.

    Counted per source first, which map tasks combine. ``co_locate`` names a key
    that a later step partitions by: the few rows left are then shuffled by that
    key once, for the totals and the later step together.
    """
    per_source = articles.groupBy(*keys, "source").agg(
        F.count("*").alias("_articles"),
        F.sum("importance").alias("_importance"),
        F.count("importance").alias("_rated"),
    )
    if co_locate is not None:
        per_source = per_source.repartition(co_locate)
    return per_source.groupBy(*keys).agg(
        F.count("source").alias("source_count"),
        F.sum("_articles").alias("article_count"),
        F.try_divide(F.sum("_importance"), F.sum("_rated")).alias("importance_avg"),
    )


def coverage_trend_history(daily: DataFrame, story: str = "story_id") -> DataFrame:
    """Trend of every story day against the story's latest earlier day."""
    by_day = Window.partitionBy(story).orderBy("date")
    previous = F.lag("source_count").over(by_day)
    return daily.withColumn("previous_count", previous).withColumn(
        "trend", trend("source_count", "previous_count")
    )


def count_before(daily: DataFrame, today: Column) -> DataFrame:
    """Source count of each story's latest day before ``today``."""
    return (
        daily.filter(F.col("date") < today)
        .groupBy("story_id")
        .agg(F.max_by("source_count", "date").alias("previous_count"))
    )


def story_bounds(daily: DataFrame, story: str = "story_id") -> DataFrame:
    """First and last day of each story that still has a daily row."""
    return daily.groupBy(story).agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen")
    )


def newest_per_label(stories: DataFrame, keys: list[str] = ["canonical_label"]) -> DataFrame:
    """One story per label: latest day first, then the larger id."""
    newest = F.max_by(
        F.struct("story_id", "last_daily"), F.struct("last_daily", "story_id")
    )
    return (
        stories.groupBy(*keys)
        .agg(newest.alias("_story"))
        .select(*keys, "_story.story_id", "_story.last_daily")
    )


def _newest_by_day(stories: DataFrame, daily: DataFrame) -> DataFrame:
    """(canonical_label, last_daily, story_id): of a label's stories of a day the largest id.

    Whatever comes before the next day of a label, all its stories of this day were last seen
    on it, so none of the others counts. Dates and ids are summed up by hash, before anything
    is ordered or laid out.
    """
    return (
        daily.select("story_id", "date")
        .join(stories.select("story_id", "canonical_label"), "story_id")
        .groupBy("canonical_label", F.col("date").alias("last_daily"))
        .agg(F.max("story_id").alias("story_id"))
    )


def recent_stories(
    stories: DataFrame, daily: DataFrame, today: Column, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Stories seen in the ``lookback_days`` before ``today``, one per label.

    The one of the latest day counts, then the larger id.
    """
    seen = daily.filter((F.col("date") >= F.date_sub(today, lookback_days)) & (F.col("date") < today))
    return (
        _newest_by_day(stories, seen)
        .groupBy("canonical_label")
        .agg(F.max_by("story_id", "last_daily").alias("story_id"), F.max("last_daily").alias("last_daily"))
    )


def recent_stories_history(
    stories: DataFrame, daily: DataFrame, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """``recent_stories`` for every run date.

    A label's day is its last one for the run dates after it up to the label's next day,
    ``lookback_days`` at most, so every row laid out is one of the result.
    """
    following = F.lead("last_daily").over(Window.partitionBy("canonical_label").orderBy("last_daily"))
    first, horizon = F.date_add("last_daily", 1), F.date_add("last_daily", lookback_days)
    last = F.least(F.coalesce(following, horizon), horizon)
    return (
        _newest_by_day(stories, daily)
        .withColumn("_last", last)
        .select(
            F.explode(F.sequence(first, F.col("_last"))).alias("today"),
            "canonical_label",
            "story_id",
            "last_daily",
        )
    )


def _memory() -> Column:
    return F.struct(
        F.col("date").alias("last_observed"),
        non_blank("summary").alias("summary"),
        non_blank("delta_summary").alias("delta_summary"),
    )


def _has_memory() -> Column:
    return ~(is_blank("summary") & is_blank("delta_summary"))


def prior_observation(observations: DataFrame, today: Column) -> DataFrame:
    """Latest observation before ``today`` that holds any text, per story."""
    return (
        observations.filter((F.col("date") < today) & _has_memory())
        .groupBy("story_id")
        .agg(F.max_by(_memory(), F.col("date")).alias("memory"))
    )


def prior_observation_history(observations: DataFrame) -> DataFrame:
    """``prior_observation`` for every story day; one observation per story and day."""
    before = Window.partitionBy("story_id").orderBy("date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    memory = F.when(_has_memory(), _memory())
    return observations.select(
        "story_id", "date", F.last(memory, ignorenulls=True).over(before).alias("memory")
    )


def _article() -> Column:
    return F.struct(*_ARTICLE_FIELDS)


def prior_articles(articles: DataFrame, today: Column, limit: int = 3) -> DataFrame:
    """The ``limit`` latest articles before ``today`` per story, newest first.

    The published time is compared as the raw text it is stored as.
    """
    latest = [F.desc("date"), F.desc("reported_at"), F.asc("id")]
    ranked = top_per_group(articles.filter(F.col("date") < today), ["story_id"], latest, limit)
    newest = F.sort_array(F.collect_list(F.struct("rank", _article().alias("article"))))
    return ranked.groupBy("story_id").agg(
        F.transform(newest, lambda r: r["article"]).alias("recent_articles")
    )


def prior_articles_history(articles: DataFrame, limit: int = 3) -> DataFrame:
    """``prior_articles`` for every story day.

    Every earlier day of a story has at least one article, so the ``limit``
    latest ones lie within its ``limit`` latest earlier days, and at most
    ``limit`` per day can count.
    """
    latest = [F.desc("reported_at"), F.asc("id")]
    ranked = top_per_group(articles, ["story_id", "date"], latest, limit)
    newest = F.sort_array(F.collect_list(F.struct("rank", _article().alias("article"))))
    days = ranked.groupBy("story_id", "date").agg(
        F.transform(newest, lambda r: r["article"]).alias("_articles")
    )
    by_day = Window.partitionBy("story_id").orderBy("date")
    earlier = [
        F.coalesce(F.lag("_articles", back).over(by_day), F.slice("_articles", 1, 0))
        for back in range(1, limit + 1)
    ]
    return days.select(
        "story_id", "date", F.slice(F.concat(*earlier), 1, limit).alias("recent_articles")
    )
