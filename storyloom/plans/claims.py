"""Claims proposed in replies, kept when their evidence is in the article."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.constants import CLAIM_VERSION
from storyloom.functions.replies import claim_fields, claim_reject_reason
from storyloom.functions.text import claim_input, claim_input_hash, fold
from storyloom.operators.ranking import top_per_group
from storyloom.session import cut_counted
from storyloom.sources.replies import claim_replies, replied_articles
from storyloom.sources.state import StateStore


@dataclass
class GroundedClaims:
    """Result of a claim run, as rows to add, move and drop."""

    hits: DataFrame
    misses: DataFrame
    claims: DataFrame
    extractions: DataFrame
    moved_claims: DataFrame
    moved_extractions: DataFrame
    rejected: DataFrame

    counts: dict[str, int]

    def counters(self) -> DataFrame:
        """Articles extracted, cached and failed, and claims rejected, as counted on the way."""
        rows = [(name, n) for name, n in self.counts.items() if n]
        return self.claims.sparkSession.createDataFrame(rows, "counter string, count bigint")


def claim_inputs(tracked: DataFrame, order: str = "ordinal") -> DataFrame:
    """(article_id, story_id, content, content_hash); articles without text are left out."""
    last = F.max_by(F.struct("story_id", "title", "description"), order)
    rows = (
        tracked.withColumn("article_id", F.col("id").cast("string"))
        .groupBy("article_id")
        .agg(last.alias("_row"))
        .select("article_id", "_row.*")
        .withColumn("content", claim_input("title", "description"))
        .filter(F.col("content") != "")
    )
    return rows.select(
        "article_id", "story_id", "content", claim_input_hash("content").alias("content_hash")
    )


def split_cached(inputs: DataFrame, extractions: DataFrame, version: str) -> DataFrame:
    """Add ``hit`` and the stored story; a result without claims is a hit as well."""
    stored = extractions.filter(F.col("version") == version).select(
        "article_id",
        F.col("content_hash").alias("_hash"),
        F.col("story_id").alias("stored_story_id"),
        "claims_count",
    )
    hit = F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
    return inputs.join(stored, "article_id", "left").withColumn("hit", hit).drop("_hash")


def judge_claims(misses: DataFrame, replies: DataFrame, version: str = CLAIM_VERSION) -> DataFrame:
    """Every proposed claim with its fields and ``reject_reason`` (null to keep).

    Contents are folded once per article, before they meet their claims.
    """
    contents = misses.select("article_id", "story_id", fold("content").alias("_folded"))
    fields = claim_replies(replies).select("article_id", "claim_pos", *claim_fields(F.col("item")))
    claim_id = F.concat_ws(":", "article_id", F.lpad(F.col("claim_pos").cast("string"), 19, "0"))
    return fields.join(contents, "article_id").select(
        claim_id.alias("claim_id"),
        "article_id",
        "story_id",
        "claim_pos",
        "claim_text",
        "claim_type",
        "entities",
        "evidence_span",
        "confidence",
        F.lit(version).alias("version"),
        claim_reject_reason("_folded").alias("reject_reason"),
    )


def ground_claims(
    tracked: DataFrame,
    claims: DataFrame,
    extractions: DataFrame,
    replies: DataFrame,
    version: str = CLAIM_VERSION,
    order: str = "ordinal",
) -> GroundedClaims:
    """Read claims for new or changed articles; cached ones follow their article.

    ``replies`` has (reply_no, article_id, reply). An article whose reply is
    missing or unusable keeps no claims and stays a miss.
    """
    checked, seen = cut_counted(
        split_cached(claim_inputs(tracked, order), extractions, version),
        cached=F.count_if("hit"),
        missed=F.count_if(~F.col("hit")),
    )
    hits = checked.filter("hit")
    misses = checked.filter(~F.col("hit"))
    judged, found = cut_counted(
        judge_claims(misses, replies, version), invalid=F.count_if(F.col("reject_reason").isNotNull())
    )
    kept = judged.filter(F.col("reject_reason").isNull())
    saved = kept.groupBy("article_id").agg(F.count("*").alias("_saved"))
    new_extractions, answered = cut_counted(
        misses.join(replied_articles(replies), "article_id", "left_semi")
        .join(saved, "article_id", "left")
        .select(
            "article_id", F.lit(version).alias("version"), "story_id", "content_hash",
            F.coalesce("_saved", F.lit(0)).alias("claims_count"),
        ),
        extracted=F.count(F.lit(1)),
    )
    moves = hits.filter(~F.col("story_id").eqNullSafe(F.col("stored_story_id")))
    moved_claims = (
        claims.filter(F.col("version") == version)
        .drop("story_id")
        .join(moves.select("article_id", "story_id"), "article_id")
        .select(*[c for c in claims.columns])
    )
    moved_extractions = moves.select(
        "article_id", F.lit(version).alias("version"), "story_id", "content_hash", "claims_count"
    )
    return GroundedClaims(
        hits=hits,
        misses=misses,
        claims=kept.drop("reject_reason", "claim_pos"),
        extractions=new_extractions,
        moved_claims=moved_claims,
        moved_extractions=moved_extractions,
        rejected=judged.filter(F.col("reject_reason").isNotNull()),
        counts={
            "cached": seen["cached"],
            "extracted": answered["extracted"],
            "failed": seen["missed"] - answered["extracted"],
            "invalid": found["invalid"],
        },
    )


def next_claims(
    claims: DataFrame, run: GroundedClaims, version: str = CLAIM_VERSION
) -> DataFrame:
    """The claims table after a run."""
    changed = (
        run.misses.select("article_id").unionByName(run.moved_extractions.select("article_id"))
    ).withColumn("version", F.lit(version))
    return (
        claims.join(changed, ["article_id", "version"], "left_anti")
        .unionByName(run.moved_claims, allowMissingColumns=True)
        .unionByName(run.claims, allowMissingColumns=True)
    )


def save_claims(store: StateStore, run: GroundedClaims, version: str = CLAIM_VERSION) -> None:
    stale = run.misses.select("article_id", F.lit(version).alias("version"))
    keys = ["article_id", "version"]
    claims = run.claims.unionByName(run.moved_claims, allowMissingColumns=True)
    extractions = run.extractions.unionByName(run.moved_extractions)
    with store.transaction():
        store.replace_keys("claims", claims, stale, keys)
        store.replace_keys("claim_extractions", extractions, stale, keys)


def story_claims(
    claims: DataFrame,
    articles: DataFrame,
    version: str = CLAIM_VERSION,
    stories: DataFrame | None = None,
) -> DataFrame:
    """One row per claim with the source, title and url of its article.

    An article stored on several days is described by its latest day. ``stories``
    (story_id, few rows) limits the work to the stories a report shows.
    """
    if stories is not None:
        claims = claims.join(stories, "story_id", "left_semi")
        articles = articles.join(stories, "story_id", "left_semi")
    described = (
        articles.groupBy(F.col("id").alias("article_id"), "story_id")
        .agg(
            F.max_by(
                F.struct("source", F.col("title").alias("article_title"), "url"),
                F.struct("date", "title"),
            ).alias("_article")
        )
    )
    return (
        claims.filter(F.col("version") == version)
        .join(described, ["article_id", "story_id"], "left")
        .select(*claims.columns, "_article.*")
    )


def best_claims(claims: DataFrame, k: int, keys: list[str] = ["story_id"]) -> DataFrame:
    """The ``k`` surest claims per story; equal ones in stored order."""
    return top_per_group(claims, keys, [F.desc("confidence"), F.asc("claim_id")], k)


def attribute_claims(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Fill a claim's blank source, title or url from today's article."""
    today = articles.groupBy(F.col("id").cast("string").alias("article_id"), "story_id").agg(
        F.max_by(
            F.struct(
                F.col("source").alias("_source"), F.col("title").alias("_title"),
                F.col("url").alias("_url"),
            ),
            "ordinal",
        ).alias("_today")
    )

    def filled(name: str, fallback: str):
        return F.coalesce(
            F.nullif(F.col(name), F.lit("")), F.col(f"_today.{fallback}"), F.lit("")
        ).alias(name)

    names = {"source": "_source", "article_title": "_title", "url": "_url"}
    return claims.join(today, ["article_id", "story_id"], "left").select(
        *[filled(c, names[c]) if c in names else F.col(c) for c in claims.columns]
    )
