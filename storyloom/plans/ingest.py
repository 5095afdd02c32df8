"""Feed items -> articles of one day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.dates import published_date, skip_reason
from storyloom.functions.urls import article_id, normalize_url
from storyloom.operators.intake import cap_per_source, first_per_key, skip_report
from storyloom.sources.pages import attach_text

ARTICLE_COLUMNS = [
    "id", "source", "language", "title", "description", "url", "published_at", "text", "ordinal",
]


@dataclass
class Ingested:
    articles: DataFrame
    skips: DataFrame


def ingest(
    items: DataFrame,
    target_date: str | None = None,
    cap: int | None = None,
    pages: DataFrame | None = None,
) -> Ingested:
    """Keep the day's items, at most ``cap`` per source, one per address.

    The cap counts items of the day in feed order, also those that turn out to
    repeat an address. Items without a link share the empty address.
    """
    target = None if target_date is None else F.lit(target_date).cast("date")
    marked = items.withColumn("skip_reason", skip_reason("published_at", target))
    # Without a reason is what was published on the day; the date alone is parsed for fewer copies.
    of_day = F.lit(True) if target is None else published_date("published_at") == target
    kept = cap_per_source(marked.filter(of_day), cap)
    addressed = kept.withColumn("address", normalize_url("url"))
    articles = first_per_key(addressed, ["address"]).select(
        article_id("address").alias("id"),
        "source",
        "language",
        "title",
        "description",
        "url",
        "published_at",
        F.lit("").alias("text"),
        "ordinal",
    )
    if pages is not None:
        articles = attach_text(articles, pages).select(*ARTICLE_COLUMNS)
    return Ingested(articles, skip_report(marked))
