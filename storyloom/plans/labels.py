"""Labels for articles: cache first, then replies, then defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.constants import (
    DEFAULT_IMPORTANCE,
    DEFAULT_STORY_LABEL,
    DEFAULT_THEME,
    LABEL_MODEL,
    LABEL_VERSION,
)
from storyloom.functions.text import content_hash
from storyloom.operators.ranking import positions
from storyloom.sources.replies import label_replies

_LABEL = ["theme", "story_label", "importance"]


@dataclass
class Labeled:
    labeled: DataFrame
    misses: DataFrame
    new_cache_rows: DataFrame


def cached_labels(
    articles: DataFrame, cache: DataFrame, model: str = LABEL_MODEL, version: str = LABEL_VERSION
) -> DataFrame:
    """(id, label) of articles whose stored label was made for the same text."""
    stored = cache.filter((F.col("model") == model) & (F.col("version") == version)).select(
        F.col("article_id").alias("id"), "content_hash", *_LABEL
    )
    hashed = articles.select("id", content_hash("title", "description").alias("content_hash"))
    return hashed.join(stored, ["id", "content_hash"]).select("id", *_LABEL)


def with_labels(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Every article with its label; articles without one get the defaults."""
    return articles.join(labels, "id", "left").select(
        *articles.columns,
        F.coalesce("theme", F.lit(DEFAULT_THEME)).alias("theme"),
        F.coalesce("story_label", F.lit(DEFAULT_STORY_LABEL)).alias("story_label"),
        F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)).alias("importance"),
    )


def label(
    articles: DataFrame,
    cache: DataFrame,
    replies: DataFrame,
    model: str = LABEL_MODEL,
    version: str = LABEL_VERSION,
) -> Labeled:
    """Label a batch. Replies count for cache misses only; defaults are not cached."""
    hits = cached_labels(articles, cache, model, version)
    misses = articles.join(hits.select("id"), "id", "left_anti")
    answered = misses.join(label_replies(replies).withColumnRenamed("article_id", "id"), "id")
    new_rows = answered.select(
        F.col("id").alias("article_id"),
        "url",
        "title",
        "description",
        content_hash("title", "description").alias("content_hash"),
        *_LABEL,
        F.lit(model).alias("model"),
        F.lit(version).alias("version"),
    )
    labels = hits.unionByName(answered.select("id", *_LABEL))
    return Labeled(with_labels(articles, labels), misses, new_rows)


def label_requests(misses: DataFrame, batch_size: int = 200) -> DataFrame:
    """JSON arrays of (id, title, description) in arrival order, ``batch_size`` each."""
    numbered = positions(misses, [], name="_position").withColumn(
        "batch", F.floor((F.col("_position") - 1) / batch_size)
    )
    item = F.struct(
        F.col("id").cast("string").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("_position", item.alias("item"))))
    return numbered.groupBy("batch").agg(
        F.to_json(F.transform(ordered, lambda r: r["item"])).alias("request"),
        F.count("*").alias("items"),
    )
