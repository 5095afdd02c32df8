"""Articles of the day by theme and story."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.constants import THEMES
from storyloom.functions.dates import reported_text
from storyloom.functions.render import digest_headline, source_line
from storyloom.functions.stories import choose, trend_code, trend_name
from storyloom.plans.briefing import article_age
from storyloom.session import cut

LINE_ORDER = [
    "theme_rank", "minus_importance", "first_ordinal", "block", "undated", "age", "item_order",
]


def digest_stories(
    tracked: DataFrame, label: str = "canonical_label", themes: list[str] = THEMES
) -> DataFrame:
    """One row per theme and story; themes outside the list are left out."""
    return _all_stories(tracked, label, themes).where("theme_rank IS NOT NULL")


def _all_stories(tracked: DataFrame, label: str, themes: list[str]) -> DataFrame:
    """Stories of every theme; those outside the list have no ``theme_rank``."""
    ranks = {theme: i + 1 for i, theme in enumerate(themes)}
    return (
        tracked.groupBy("theme", F.col(label).alias("label"))
        .agg(
            F.max("importance").alias("max_importance"),
            F.min_by(trend_code("trend"), F.col("ordinal")).alias("_trend"),
            F.min("ordinal").alias("first_ordinal"),
            F.count("*").alias("article_count"),
        )
        .withColumn("theme_rank", choose("theme", ranks, None))
        .withColumn("trend", trend_name("_trend"))
        .drop("_trend")
    )


def digest_lines(
    tracked: DataFrame,
    generated_at: str,
    label: str = "canonical_label",
    themes: list[str] = THEMES,
) -> DataFrame:
    """Digest lines with their place in the reading order (``LINE_ORDER``).

    The order is carried as sort keys, so the lines are written by a range sort
    and no theme or story is numbered in one task.
    """
    if "trend" not in tracked.columns:
        tracked = tracked.withColumn("trend", F.lit(None).cast("string"))
    # Articles are read twice: for their stories, written once, and for their lines.
    every = cut(_all_stories(tracked, label, themes))
    stories = every.where("theme_rank IS NOT NULL")
    place = [F.col("theme_rank"), (-F.col("max_importance")).alias("minus_importance"),
             F.col("first_ordinal")]

    def line(block, text, undated=F.lit, age=None, item=None):
        return [
            block.cast("int").alias("block"),
            (F.lit(0) if undated is F.lit else undated).cast("int").alias("undated"),
            (F.lit(0) if age is None else age).cast("bigint").alias("age"),
            (F.lit(0) if item is None else item).cast("bigint").alias("item_order"),
            text.alias("line"),
        ]

    heads = stories.select(
        *place,
        F.posexplode(
            F.array(digest_headline("trend", "label", "max_importance"), F.lit(""))
        ).alias("_pos", "_text"),
    ).select("theme_rank", "minus_importance", "first_ordinal", *line(F.col("_pos"), F.col("_text")))
    gaps = stories.select(*place, *line(F.lit(300), F.lit("")))
    themed = (
        stories.select("theme", "theme_rank").distinct()
        .select(
            "theme_rank",
            F.posexplode(F.array(F.concat(F.lit("## "), F.col("theme")), F.lit(""))).alias("_pos", "_text"),
        )
        .select(
            "theme_rank",
            F.lit(-1_000_000).alias("minus_importance"),
            F.lit(-1).cast("bigint").alias("first_ordinal"),
            *line(F.col("_pos"), F.col("_text")),
        )
    )
    text = source_line("source", reported_text("published_at", "reported_ts"), "title", "url")
    articles = tracked.withColumnRenamed(label, "label").join(
        stories.select("theme", "label", "theme_rank", "max_importance", "first_ordinal"),
        ["theme", "label"],
    ).select(
        *place,
        *line(
            F.lit(100), text, F.col("reported_ts").isNull(), article_age("reported_ts"),
            F.col("ordinal"),
        ),
    )
    count = every.groupBy().agg(F.coalesce(F.sum("article_count"), F.lit(0)).alias("_n"))
    stamp = F.concat(
        F.lit(f"_Generated {generated_at} — "), F.col("_n").cast("string"), F.lit(" articles_")
    )
    opening = F.when(
        F.col("_n") == 0,
        F.array(F.lit("# News Digest"), stamp, F.lit(""), F.lit("No articles found.")),
    ).otherwise(F.array(F.lit("# News Digest"), stamp, F.lit(""), F.lit("---"), F.lit("")))
    top = count.select(F.posexplode(opening).alias("_pos", "_text")).select(
        F.lit(0).alias("theme_rank"),
        F.lit(0).alias("minus_importance"),
        F.lit(0).cast("bigint").alias("first_ordinal"),
        *line(F.col("_pos"), F.col("_text")),
    )
    return top.unionByName(themed).unionByName(heads).unionByName(articles).unionByName(gaps)
