"""Story locations from place names in labels and article texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.constants import GAZETTEER, GLOBAL_KEYWORDS
from storyloom.functions.places import (
    article_place_text,
    gazetteer_table,
    mentions_global,
    name_starts,
    name_table,
    pieces,
    starts_with_name,
)
from storyloom.functions.text import fold

LABEL_WEIGHT = 3
ARTICLE_WEIGHT = 1

# Names of so many places at most are sent to all tasks; of more, Spark decides by size.
BROADCAST_NAMES = 100_000

# Of so many names at most the first pieces are listed, so that other pieces go at once.
LISTED_NAMES = 10_000

_PLACE = ["place_rank", "label", "lat", "lon", "scope"]


def _names(articles: DataFrame, gazetteer) -> tuple[DataFrame, int, list[str] | None]:
    """The table of names, the number of pieces of the longest, and first pieces if few."""
    spark = articles.sparkSession
    table = gazetteer if isinstance(gazetteer, DataFrame) else gazetteer_table(spark, gazetteer)
    names = name_table(table)
    size = names.agg(F.max("length").alias("longest"), F.count("*").alias("n")).first()
    firsts = None
    if size["n"] <= LISTED_NAMES:
        firsts = [r["first"] for r in names.select("first").distinct().collect()]
    return F.broadcast(names) if size["n"] <= BROADCAST_NAMES else names, size["longest"] or 1, firsts


def _found(texts: DataFrame, names: DataFrame, longest: int, firsts: list[str] | None) -> DataFrame:
    """``texts`` with the names that stand in ``_text``; a row without a name for every text.

    The pieces that start no name end here, before anything is shuffled.
    """
    columns = [c for c in texts.columns if c != "_text"]
    cut = texts.withColumn("_pieces", pieces("_text"))
    found = F.posexplode_outer(name_starts("_pieces", longest, firsts)).alias("_pos", "_start")
    starts = cut.select(*columns, found)
    first = F.coalesce("_pos", F.lit(0)) == 0
    hit = (F.col("_start.first") == F.col("first")) & starts_with_name("_start", "alias")
    return (
        starts.join(names, hit, "left")
        .where(first | F.col("alias").isNotNull())
        .select(*columns, "alias", *_PLACE)
    )


def _evidence(articles: DataFrame, gazetteer, keywords: list[str]) -> DataFrame:
    """One row per story and name found, or without a name; what any of its texts says.

    Articles are read once for their texts and once for the labels alone.
    """
    names, longest, firsts = _names(articles, gazetteer)
    nothing = F.lit(False)
    theme = F.col("theme") == "Economy" if "theme" in articles.columns else nothing
    in_articles = articles.select(
        "canonical_label",
        article_place_text(F.col("title"), F.col("description")).alias("_text"),
        F.coalesce(theme, nothing).alias("economy"),
    ).withColumn("in_label", F.lit(0))
    in_labels = (
        articles.select("canonical_label")
        .distinct()
        .select("canonical_label", fold("canonical_label").alias("_text"), nothing.alias("economy"))
        .withColumn("in_label", F.lit(1))
    )

    def look(texts: DataFrame) -> DataFrame:
        said = texts.withColumn("global", mentions_global(F.col("_text"), keywords)).withColumn(
            "has_text", F.col("_text") != ""
        )
        return _found(said, names, longest, firsts)

    return (
        look(in_articles)
        .unionByName(look(in_labels))
        .groupBy("canonical_label", "alias", *_PLACE)
        .agg(
            F.max("in_label").alias("in_label"),
            F.max(1 - F.col("in_label")).alias("in_article"),
            *[F.bool_or(c).alias(c) for c in ("economy", "global", "has_text")],
        )
    )


def _by_place(evidence: DataFrame) -> DataFrame:
    """Evidence summed by story and place; the row without a place stays."""
    weight = F.col("in_label") * LABEL_WEIGHT + F.col("in_article") * ARTICLE_WEIGHT
    return evidence.groupBy("canonical_label", *_PLACE).agg(
        F.sum(weight).cast("bigint").alias("score"),
        *[F.bool_or(c).alias(c) for c in ("economy", "global", "has_text")],
    )


def place_scores(articles: DataFrame, gazetteer=GAZETTEER) -> DataFrame:
    """Score of every place a story mentions: 3 per alias in its label, 1 per
    alias in any of its articles.

    ``gazetteer`` is a list of places or a table (place_rank, label, lat, lon, scope, alias).
    """
    found = _by_place(_evidence(articles, gazetteer, GLOBAL_KEYWORDS)).where("place_rank IS NOT NULL")
    return found.select("canonical_label", "place_rank", "score", "label", "lat", "lon", "scope")


def _location(ranked: Column, total: Column, has_text: Column, is_global: Column) -> Column:
    top, second = ranked[0], F.get(ranked, F.lit(1))
    single = second.isNull() | (top["score"] >= second["score"] * 2)
    points = F.transform(
        F.when(single, F.slice(ranked, 1, 1)).otherwise(F.slice(ranked, 1, 3)),
        lambda p: F.struct(p["label"].alias("label"), p["lat"].alias("lat"), p["lon"].alias("lon")),
    )
    joined = F.concat(
        F.array_join(F.transform(F.slice(ranked, 1, 3), lambda p: p["label"]), " / "),
        F.when(total > 3, F.concat(F.lit(" +"), (total - 3).cast("string"))).otherwise(F.lit("")),
    )
    sure = F.when(top["score"] >= 3, F.lit("high")).otherwise(F.lit("medium"))

    def row(scope: Column, label: Column, confidence: Column, at: Column) -> Column:
        return F.struct(
            scope.alias("scope"), label.alias("label"), confidence.alias("confidence"), at.alias("points")
        )

    nowhere = F.slice(points, 1, 0)
    return (
        F.when(ranked.isNotNull() & single, row(top["scope"], top["label"], sure, points))
        .when(ranked.isNotNull(), row(F.lit("multi-region"), joined, F.lit("medium"), points))
        .when(
            has_text & is_global,
            row(F.lit("global"), F.lit("Global"), F.lit("medium"), F.coalesce(nowhere, _no_points())),
        )
        .otherwise(
            row(F.lit("unknown"), F.lit("Unknown"), F.lit("low"), F.coalesce(nowhere, _no_points()))
        )
    )


def _no_points() -> Column:
    return F.array().cast("array<struct<label: string, lat: double, lon: double>>")


def story_locations(
    articles: DataFrame, gazetteer=GAZETTEER, keywords: list[str] = GLOBAL_KEYWORDS
) -> DataFrame:
    """One location per story: a place, several places, global or unknown.

    Phrases are looked for in the label and in each article; a phrase that would
    only arise by joining two neighbouring articles does not count. ``gazetteer``
    is as in ``place_scores``.
    """
    placed = F.struct(
        (-F.col("score")).alias("_down"), "place_rank", "label", "lat", "lon", "scope", "score"
    )
    # At most one element for each place of the gazetteer.
    listed = F.sort_array(F.collect_list(F.when(F.col("place_rank").isNotNull(), placed)))
    stories = _by_place(_evidence(articles, gazetteer, keywords)).groupBy("canonical_label").agg(
        listed.alias("_all"), *[F.bool_or(c).alias(c) for c in ("economy", "global", "has_text")]
    )
    total = F.size("_all")
    return stories.select(
        "canonical_label",
        _location(
            F.when(total > 0, F.slice("_all", 1, 3)), total, F.col("has_text"), F.col("global") | F.col("economy")
        ).alias("location"),
    )
