"""Report sections: leads, politics, economy and other stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.stories import (
    edition_rank,
    edition_title,
    is_economy,
    is_lead,
    is_other_important,
    is_politics,
)
from storyloom.operators.ranking import top_per_group


def section_limits(n: int = 3, global_n: int = 10) -> list[int]:
    """Stories shown in the leads, politics, economy and other sections."""
    rest = max(3, min(global_n, 6))
    return [min(max(n, 3), 8), global_n, rest, rest]


def lead_stories(stories: DataFrame, n: int = 3) -> DataFrame:
    """Top stories by score among those fit to lead."""
    return (
        stories.filter(is_lead())
        .orderBy(F.desc("score"), F.asc("first_ordinal"))
        .limit(section_limits(n)[0])
    )


def _pick(candidates: Column, limits: list[int]) -> Column:
    """Walk the candidates section by section; a story is used once."""
    limit_of = F.array(*[F.lit(k) for k in limits])

    def take(picked: Column, candidate: Column) -> Column:
        used = F.exists(picked, lambda p: p["canonical_label"] == candidate["canonical_label"])
        taken = F.size(F.filter(picked, lambda p: p["section_rank"] == candidate["section_rank"]))
        wanted = ~used & (taken < F.element_at(limit_of, candidate["section_rank"]))
        row = F.struct(
            candidate["section_rank"].alias("section_rank"),
            candidate["canonical_label"].alias("canonical_label"),
            (taken + 1).alias("rank"),
            candidate["story"].alias("story"),
        )
        return F.when(wanted, F.array_append(picked, row)).otherwise(picked)

    return F.aggregate(candidates, F.slice(F.transform(
        candidates,
        lambda c: F.struct(
            c["section_rank"].alias("section_rank"),
            c["canonical_label"].alias("canonical_label"),
            F.lit(0).alias("rank"),
            c["story"].alias("story"),
        ),
    ), 1, 0), take)


def select_sections(
    stories: DataFrame,
    n: int = 3,
    global_n: int = 10,
    sections: list[Column] | None = None,
) -> DataFrame:
    """Stories of every section with ``section_rank`` (from 1) and ``rank``.

    A section takes its best stories that no earlier section shows. Earlier
    sections show at most the sum of their limits, so that many more candidates
    per section are enough: one pass over the stories keeps those few, and the
    exclusion is settled on them.
    """
    limits = section_limits(n, global_n)
    sections = sections or [is_lead(), is_politics(), is_economy(), is_other_important()]
    needed = [sum(limits[: i + 1]) for i in range(len(limits))]
    eligible = F.array_compact(
        F.array(*[F.when(fits, F.lit(i + 1)) for i, fits in enumerate(sections)])
    )
    entries = stories.withColumn("section_rank", F.explode(eligible))
    best = top_per_group(
        entries, ["section_rank"], [F.desc("score"), F.asc("first_ordinal")], max(needed), "_best"
    ).filter(F.col("_best") <= F.element_at(F.array(*[F.lit(k) for k in needed]), F.col("section_rank")))
    candidates = F.sort_array(
        F.collect_list(
            F.struct(
                "section_rank",
                "_best",
                "canonical_label",
                F.struct(*[c for c in stories.columns]).alias("story"),
            )
        )
    )
    return (
        best.groupBy()
        .agg(_pick(candidates, limits).alias("_picked"))
        .select(F.explode("_picked").alias("_row"))
        .select("_row.section_rank", "_row.rank", "_row.story.*")
    )


def first_shown(rows: DataFrame) -> DataFrame:
    """Each label once, where it is shown first."""
    shown = F.struct("section_rank", "rank")
    return (
        rows.groupBy("canonical_label")
        .agg(F.min_by(F.struct(*rows.columns), shown).alias("_row"))
        .select("_row.*")
    )


def edition_sections(rows: DataFrame) -> DataFrame:
    """Displayed stories regrouped by movement; numbering follows display order."""
    ranked = first_shown(rows).withColumn("edition_rank", edition_rank("trend"))
    return ranked.withColumn("edition_title", edition_title("edition_rank"))
