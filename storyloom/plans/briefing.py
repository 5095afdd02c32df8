"""Stories of the day -> briefing: sections, texts, requests and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.constants import BRIEFING_SECTIONS
from storyloom.functions.dates import reported_text
from storyloom.functions.render import (
    evidence_line,
    fallback_briefing,
    fallback_delta,
    headline,
    source_line,
    story_meta,
)
from storyloom.functions.stories import choose
from storyloom.functions.text import is_blank, non_blank
from storyloom.operators.ranking import positions, top_per_group
from storyloom.operators.rollup import story_details, story_metrics, with_score
from storyloom.operators.sections import first_shown, select_sections
from storyloom.operators.tables import merge_payloads
from storyloom.plans.claims import attribute_claims, best_claims
from storyloom.session import cut

SHOWN_CLAIMS = 8
REQUESTED_CLAIMS = 12
_SECTION_TITLES = {i + 1: title for i, title in enumerate(BRIEFING_SECTIONS)}

# Reading order of the lines; dated sources come newest first, undated ones last.
LINE_ORDER = ["section_rank", "rank", "block", "undated", "age", "item_order"]


def briefing_stories(
    tracked: DataFrame,
    n: int = 3,
    global_n: int = 10,
    order: Column | None = None,
    contexts: DataFrame | None = None,
) -> DataFrame:
    """Stories of every section with section_rank and rank; at most a few dozen rows.

    The selection is written down before the texts of the selected stories are
    looked up, so that the ranking of all stories runs once.
    """
    picked = cut(select_sections(with_score(story_metrics(tracked, order)), n, global_n))
    return story_details(tracked, picked, order, contexts)


def fill_texts(picked: DataFrame, payloads: DataFrame, retry: DataFrame | None = None) -> DataFrame:
    """Add briefing and delta: reply, else retry, else a sentence made from the story."""
    texts = payloads if retry is None else merge_payloads(payloads, retry)
    texts = texts.select(
        "canonical_label",
        non_blank("briefing").alias("_briefing"),
        non_blank("delta_summary").alias("_delta"),
    )
    made = fallback_briefing(
        "canonical_label", "source_count", "latest_reported", "lead.source", "lead.title"
    )
    return (
        picked.join(texts, "canonical_label", "left")
        .withColumn("briefing", F.coalesce("_briefing", made))
        .withColumn("delta", F.coalesce("_delta", _fallback_delta()))
        .drop("_briefing", "_delta")
    )


def _fallback_delta() -> Column:
    return fallback_delta(F.col("previous_context").isNotNull(), "trend")


def story_memories(filled: DataFrame) -> DataFrame:
    """(observation_id, summary, delta_summary) to write back for displayed stories."""
    return (
        first_shown(filled.select("canonical_label", "section_rank", "rank", "briefing", "delta",
                                  "observation_ids"))
        .filter(~is_blank("briefing"))
        .select(
            F.explode("observation_ids").alias("observation_id"),
            F.col("briefing").alias("summary"),
            F.col("delta").alias("delta_summary"),
        )
    )


def _request_articles(
    tracked: DataFrame, labels: DataFrame, part_size: int, ordinal: str, major: str | None
) -> DataFrame:
    """Articles of the given stories in parts of ``part_size``, in article order."""
    wanted = tracked.join(F.broadcast(labels), "canonical_label", "left_semi")
    numbered = positions(wanted, ["canonical_label"], ordinal, major, "_position")
    article = F.struct(
        "source",
        "title",
        "description",
        F.coalesce("published_at", F.lit("")).alias("reported_at"),
        F.coalesce("url", F.lit("")).alias("url"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("_position", article.alias("article"))))
    return (
        numbered.withColumn("part", F.floor((F.col("_position") - 1) / part_size))
        .groupBy("canonical_label", "part")
        .agg(F.transform(ordered, lambda r: r["article"]).alias("articles"))
    )


def briefing_requests(
    tracked: DataFrame,
    picked: DataFrame,
    claims: DataFrame | None = None,
    part_size: int = 1000,
    ordinal: str = "ordinal",
    major: str | None = None,
) -> DataFrame:
    """One JSON request per story and part.

    A story of up to ``part_size`` articles is one part. A larger one continues
    in further parts, so no row holds more than ``part_size`` articles. The
    earlier context and the claims go with the first part. ``picked`` holds the
    displayed stories (at most the sum of the section limits).
    """
    shown = first_shown(
        picked.select("canonical_label", "section_rank", "rank", "previous_context", "story_id")
    )
    parts = _request_articles(tracked, shown.select("canonical_label"), part_size, ordinal, major)
    joined = parts.join(shown, "canonical_label")
    first = F.col("part") == 0
    fields = [
        "canonical_label",
        "articles",
        F.when(first, F.col("previous_context")).alias("previous_context"),
        # Left out of the first part; a reply to another one repeats it.
        F.when(~first, F.col("part")).alias("part"),
    ]
    if claims is not None:
        joined = joined.join(_request_claims(tracked, shown, claims), "story_id", "left")
        none = F.array().cast(joined.schema["_claims"].dataType)
        fields.append(F.when(first, F.coalesce("_claims", none)).alias("claims"))
    return joined.select(
        "canonical_label", "part", F.size("articles").alias("articles"),
        F.to_json(F.struct(*fields)).alias("request"),
    )


def _request_claims(tracked: DataFrame, shown: DataFrame, claims: DataFrame) -> DataFrame:
    """Up to 12 surest claims per story, as the array that goes into its request."""
    wanted = claims.join(F.broadcast(shown.select("story_id")), "story_id", "left_semi")
    best = best_claims(wanted, REQUESTED_CLAIMS)
    filled = attribute_claims(best, tracked.join(best, "story_id", "left_semi"))
    claim = F.struct(
        "claim_text", "claim_type", "evidence_span", "confidence", "source", "article_title", "url"
    )
    ordered = F.sort_array(F.collect_list(F.struct("rank", claim.alias("claim"))))
    return filled.groupBy("story_id").agg(
        F.transform(ordered, lambda r: r["claim"]).alias("_claims")
    )


def _line(block: Column, line: Column, undated=None, age=None, item=None) -> list[Column]:
    return [
        F.col("section_rank"),
        F.col("rank"),
        block.cast("int").alias("block"),
        (F.lit(0) if undated is None else undated).cast("int").alias("undated"),
        (F.lit(0) if age is None else age).cast("bigint").alias("age"),
        (F.lit(0) if item is None else item).cast("bigint").alias("item_order"),
        line.alias("line"),
    ]


def article_age(moment: Column | str) -> Column:
    """Microseconds the moment lies before the end of 9999; undated articles have 0."""
    moment = F.col(moment) if isinstance(moment, str) else moment
    left = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - moment
    micros = (
        F.extract(F.lit("DAY"), left).cast("bigint") * 86_400_000_000
        + F.extract(F.lit("HOUR"), left).cast("bigint") * 3_600_000_000
        + F.extract(F.lit("MINUTE"), left).cast("bigint") * 60_000_000
        + (F.extract(F.lit("SECOND"), left) * 1_000_000).cast("bigint")
    )
    return F.coalesce(micros, F.lit(0))


def source_lines(tracked: DataFrame, shown: DataFrame) -> DataFrame:
    """One line per article of the shown stories; ``shown`` is bounded by the limits."""
    rows = tracked.join(
        F.broadcast(shown.select("canonical_label", "section_rank", "rank")), "canonical_label"
    )
    line = source_line(
        "source", reported_text("published_at", "reported_ts"), "title", "url"
    )
    return rows.select(
        *_line(
            F.lit(100), line, F.col("reported_ts").isNull(), article_age("reported_ts"),
            F.col("ordinal"),
        )
    )


def evidence_lines(claims: DataFrame, shown: DataFrame) -> DataFrame:
    """Heading and up to 8 evidence lines of every shown story that has evidence."""
    stories = shown.select("story_id", "section_rank", F.col("rank").alias("story_rank"))
    rows = claims.filter(F.coalesce("evidence_span", F.lit("")) != "").join(
        F.broadcast(stories), "story_id"
    )
    surest = [F.desc("confidence"), F.asc("claim_id")]
    best = top_per_group(
        rows, ["section_rank", "story_rank"], surest, SHOWN_CLAIMS, "claim_rank"
    ).withColumnRenamed("story_rank", "rank")
    line = evidence_line("claim_type", "source", "url", "evidence_span", "confidence")
    heading = F.posexplode(F.array(F.lit(""), F.lit("### Evidence"))).alias("_pos", "_text")
    heads = best.filter(F.col("claim_rank") == 1).select("section_rank", "rank", heading)
    return best.select(*_line(F.lit(210), line, item=F.col("claim_rank"))).unionByName(
        heads.select(*_line(F.lit(200) + F.col("_pos"), F.col("_text")))
    )


def briefing_lines(
    filled: DataFrame,
    tracked: DataFrame,
    generated_at: str,
    claims: DataFrame | None = None,
) -> DataFrame:
    """Briefing lines with their place in the reading order (``LINE_ORDER``)."""
    delta = F.coalesce(non_blank("delta"), _fallback_delta())
    story = F.array(
        headline("rank", "trend", "canonical_label"),
        story_meta("themes", "importance_avg", "source_count", "latest_reported"),
        F.lit(""),
        F.concat(F.lit("**What changed today:** "), delta),
        F.lit(""),
        F.coalesce("briefing", F.lit("")),
        F.lit(""),
        F.lit("Sources:"),
    )
    stories = filled.select(
        "section_rank", "rank", F.posexplode(story).alias("_pos", "_text")
    ).select(*_line(F.col("_pos"), F.col("_text")))
    gaps = filled.select(*_line(F.lit(300), F.lit("")))
    title = F.concat(F.lit("# "), choose("section_rank", _SECTION_TITLES))
    section = F.array(F.lit("---"), F.lit(""), title, F.lit(""))
    heads = (
        filled.filter((F.col("section_rank") > 1) & (F.col("rank") == 1))
        .select("section_rank", F.lit(0).alias("rank"), F.posexplode(section).alias("_pos", "_text"))
        .select(*_line(F.col("_pos"), F.col("_text")))
    )
    # The report heading stands on its own when no story was tracked at all.
    any_story = tracked.select("canonical_label").limit(1).agg((F.count("*") > 0).alias("_any"))
    top = F.array(F.lit(f"# {BRIEFING_SECTIONS[0]}"), F.lit(f"_{generated_at}_"), F.lit(""))
    notice = F.when(
        ~F.col("_any"), F.array_append(top, F.lit("No tracked stories found."))
    ).otherwise(top)
    opening = any_story.select(
        F.lit(0).alias("section_rank"), F.lit(0).alias("rank"),
        F.posexplode(notice).alias("_pos", "_text"),
    ).select(*_line(F.col("_pos"), F.col("_text")))
    parts = [stories, source_lines(tracked, filled), gaps, heads]
    if claims is not None:
        parts.append(evidence_lines(claims, filled))
    lines = opening
    for part in parts:
        lines = lines.unionByName(part)
    return lines
