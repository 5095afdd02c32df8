"""Landed feed files -> feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.constants import FEEDS
from storyloom.functions.text import clean
from storyloom.session import cut

_ITEM = "struct<title: string, link: string, description: string, pubDate: string>"
# Items sit in the channel in most feeds and next to it in RDF ones.
_FEED = f"struct<channel: struct<item: array<{_ITEM}>>, item: array<{_ITEM}>, _unread: string>"
# Room for the items of one feed file in the arrival order.
_ITEMS_PER_FEED = 1 << 32


def feed_catalogue(spark: SparkSession, feeds=FEEDS) -> DataFrame:
    rows = [(rank, *feed) for rank, feed in enumerate(feeds)]
    return spark.createDataFrame(rows, "source_rank bigint, source string, language string, url string")


def scan_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """``feeds`` with ``items`` in place of the XML, and ``reject_reason`` where there are none to read.

    Every file is parsed once. One that is cut off or not XML is ``malformed_xml`` and keeps
    its text in ``unread``; one without a channel or an item is ``no_feed``.
    """
    parsed = F.from_xml(xml, _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    none = F.array().cast(f"array<{_ITEM}>")
    kept = [c for c in feeds.columns if c != xml]
    feed = F.col("_feed")
    unread = F.when(F.col(xml).isNull(), F.lit("")).otherwise(feed["_unread"])
    nothing = feed["channel"].isNull() & feed["item"].isNull()
    return feeds.select(*kept, xml, parsed.alias("_feed")).select(
        *kept,
        F.concat(F.coalesce(feed["channel"]["item"], none), F.coalesce(feed["item"], none)).alias("items"),
        F.when(unread.isNotNull(), F.lit("malformed_xml")).when(nothing, F.lit("no_feed")).alias("reject_reason"),
        F.when(unread.isNotNull(), unread).when(nothing, F.col(xml)).alias("unread"),
    )


def feed_items(scanned: DataFrame) -> DataFrame:
    """One row per ``<item>`` of scanned feeds; a missing child is the empty text."""
    return scanned.select(
        "source", "language", "source_rank", F.posexplode("items").alias("item_pos", "item")
    ).select(
        "source",
        "language",
        F.col("item_pos").cast("bigint").alias("item_pos"),
        (F.col("source_rank") * _ITEMS_PER_FEED + F.col("item_pos")).alias("ordinal"),
        clean("item.title").alias("title"),
        clean("item.link").alias("url"),
        clean("item.description").alias("description"),
        clean("item.pubDate").alias("published_at"),
    )


def parse_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per ``<item>``.

    ``feeds`` has source, language, source_rank and the XML text of one file per
    row. Files that can't be read yield no items, so one bad feed does not stop the
    rest; ``feed_rejects`` names them.
    """
    return feed_items(scan_feeds(feeds, xml))


def feed_rejects(scanned: DataFrame) -> DataFrame:
    """Files without a readable feed, with the reason and their text."""
    kept = [c for c in scanned.columns if c not in ("items", "reject_reason", "unread")]
    return scanned.where("reject_reason IS NOT NULL").select(*kept, "reject_reason", "unread")


def read_feeds(
    spark: SparkSession, path: str, catalogue: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Items of the feed files landed as ``<path>/<source>.xml``, and the files that can't be read.

    Feeds outside of ``catalogue`` are kept, without a language, after those inside.
    Files are numbered in catalogue order, then by name and path, so items of several files
    of one feed never share an ordinal. Files are read and parsed once; their items are
    written to the run's folder.
    """
    catalogue = feed_catalogue(spark) if catalogue is None else catalogue
    name = F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]+)\.xml$", 1)
    landed = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("xml"), name.alias("source"), F.input_file_name().alias("file")
    )
    scanned = cut(scan_feeds(landed))
    known = catalogue.select("source", "language", F.col("source_rank").alias("_rank"))
    # Only names are numbered in one place: one row a landed file.
    order = Window.orderBy(F.asc_nulls_last("_rank"), "source", "file")
    files = (
        scanned.select("source", "file")
        .join(known, "source", "left")
        .select(
            "file",
            F.coalesce("language", F.lit("")).alias("language"),
            (F.row_number().over(order) - 1).cast("bigint").alias("source_rank"),
        )
    )
    return feed_items(scanned.join(files, "file")), feed_rejects(scanned)
