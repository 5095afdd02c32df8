"""What is known of stories before a day, kept as one row per story and day.

A row holds the story's own part of that day (count, memory, three latest articles) and how
memory and latest articles stand after it, so a look-back reads one row. Which dates have
rows is known without reading any: a run of today reads the days of the look-back window
and no other; a rebuild of an older date follows ``previous_date`` from the story's next day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import is_blank, non_blank
from storyloom.operators.coverage import newest_per_label
from storyloom.operators.ranking import top_per_group

ARTICLE_FIELDS = ["date", "source", "title", "description", "url", "reported_at"]
PRIOR = "previous_date", "previous_count", "first_seen", "memory", "recent_articles"
LATEST = 3


def recent_labels(days: DataFrame) -> DataFrame:
    """Stories of the days of a look-back window, one per label."""
    seen = days.groupBy("story_id").agg(
        F.max("date").alias("last_daily"), F.first("canonical_label").alias("canonical_label")
    )
    return newest_per_label(seen)


def labels_alive(days: DataFrame, today: Column) -> DataFrame:
    """Newest story per exact label, of the days from the window's start on."""
    seen = days.groupBy("story_id").agg(
        F.max("date").alias("last_seen"),
        F.min("first_seen").alias("first_seen"),
        F.first("canonical_label").alias("canonical_label"),
    )
    newest = F.max_by("story_id", F.struct("last_seen", "story_id"))
    return seen.filter(F.col("first_seen") <= today).groupBy("canonical_label").agg(newest.alias("label_id"))


def _prior() -> list[Column]:
    return [
        F.col("date").alias("previous_date"),
        F.col("source_count").alias("previous_count"),
        "first_seen",
        "memory",
        "recent_articles",
    ]


def latest_before(days: DataFrame, ids: DataFrame) -> DataFrame:
    """Each story's newest row of the given days, as what is known after them."""
    rows = days.join(ids, "story_id", "left_semi")
    return (
        rows.groupBy("story_id")
        .agg(F.max_by(F.struct(*_prior()), "date").alias("_row"))
        .select("story_id", *[F.col(f"_row.{c}").alias(c) for c in PRIOR])
    )


def follow_back(later: DataFrame, earlier: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``earlier`` that each story's first later row points back to."""
    first = later.join(ids, "story_id", "left_semi").groupBy("story_id").agg(
        F.min_by("previous_date", "date").alias("date")
    )
    return earlier.join(first, ["story_id", "date"]).select("story_id", *_prior())


def own_articles(articles: DataFrame, keys: list[str] = ["story_id"]) -> DataFrame:
    """(*keys, own_articles): the latest articles of one day, or of each where keys have the date."""
    shaped = articles.select(
        "story_id", "id", "date", "source", "title",
        F.coalesce("description", F.lit("")).alias("description"), "url",
        F.coalesce("published_at", F.lit("")).alias("reported_at"),
    )
    ranked = top_per_group(shaped, keys, [F.desc("reported_at"), F.asc("id")], LATEST)
    newest = F.sort_array(F.collect_list(F.struct("rank", F.struct(*ARTICLE_FIELDS).alias("article"))))
    return ranked.groupBy(*keys).agg(F.transform(newest, lambda r: r["article"]).alias("own_articles"))


def _memory_of(observations: DataFrame, *keys: str) -> DataFrame:
    """(*keys, _said) of the observations that hold any text."""
    memory = F.struct(
        F.col("date").alias("last_observed"),
        non_blank("summary").alias("summary"),
        non_blank("delta_summary").alias("delta_summary"),
    )
    has_text = ~(is_blank("summary") & is_blank("delta_summary"))
    return observations.filter(has_text).select(*keys, memory.alias("_said"))


def days_from_tables(
    stories: DataFrame, daily: DataFrame, observations: DataFrame, articles: DataFrame
) -> DataFrame:
    """Rows for all days at once, for a state that was kept without them."""
    keys = ["story_id", "date"]
    rows = (
        daily.select(*keys, "source_count")
        .join(stories.select("story_id", "canonical_label"), "story_id")
        .join(own_articles(articles, keys), keys, "left")
        .join(_memory_of(observations, *keys), keys, "left")
        .select(
            *keys, "canonical_label", F.col("date").alias("first_seen"),
            F.lit(None).cast("date").alias("previous_date"), "source_count",
            F.col("_said").alias("own_memory"), "own_articles", F.col("_said").alias("memory"),
            F.col("own_articles").alias("recent_articles"),
        )
    )
    return carry_on(rows.limit(0), rows)


def _no_articles() -> Column:
    return F.slice("own_articles", 1, 0)


def day_rows(stories: DataFrame, articles: DataFrame, day: Column) -> DataFrame:
    """Rows of one day. ``stories`` has the day's stories with what was known before (PRIOR)."""
    own = own_articles(articles)
    known = F.coalesce("recent_articles", _no_articles())
    return stories.join(own, "story_id", "left").select(
        "story_id",
        day.alias("date"),
        "canonical_label",
        F.coalesce("first_seen", day).alias("first_seen"),
        "previous_date",
        "source_count",
        F.lit(None).cast("struct<last_observed: date, summary: string, delta_summary: string>").alias("own_memory"),
        "own_articles",
        "memory",
        F.slice(F.concat(F.coalesce("own_articles", F.array()), known), 1, LATEST).alias("recent_articles"),
    )


def remember(days: DataFrame, observations: DataFrame) -> DataFrame:
    """The rows of a day after its observations got their texts."""
    said = _memory_of(observations, "story_id")
    return (
        days.join(said, "story_id", "left")
        .withColumn("own_memory", F.coalesce("_said", "own_memory"))
        .withColumn("memory", F.coalesce("_said", "memory"))
        .drop("_said")
    )


def carry_on(seeds: DataFrame, later: DataFrame) -> DataFrame:
    """``later`` with what is carried from day to day, starting from one row per story."""
    columns = later.columns
    rows = seeds.withColumn("_seed", F.lit(True)).unionByName(later.withColumn("_seed", F.lit(False)))
    by_day = Window.partitionBy("story_id").orderBy("date")
    up_to = by_day.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_seed"), F.col("recent_articles")).otherwise(F.col("own_articles"))
    rows = rows.withColumn("_own", F.coalesce(own, F.array().cast(later.schema["own_articles"].dataType)))
    earlier = [F.coalesce(F.lag("_own", back).over(by_day), F.slice("_own", 1, 0)) for back in range(1, LATEST)]
    said = F.when(F.col("_seed"), F.col("memory")).otherwise(F.col("own_memory"))
    first = F.min(F.when(F.col("_seed"), F.col("first_seen")).otherwise(F.col("date"))).over(up_to)
    return (
        rows.withColumn("previous_date", F.lag("date").over(by_day))
        .withColumn("memory", F.last(said, ignorenulls=True).over(up_to))
        .withColumn("recent_articles", F.slice(F.concat("_own", *earlier), 1, LATEST))
        .withColumn("first_seen", first)
        .filter(~F.col("_seed"))
        .select(*columns)
    )
