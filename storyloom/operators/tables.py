"""Changes to state tables, expressed as the table that should be there next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import clean, is_blank, non_blank


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` replace whole rows of ``current`` with the same key."""
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def rebuild_date(current: DataFrame, rebuilt: DataFrame, date: Column) -> DataFrame:
    """All rows of one date replaced; other dates as they are."""
    return current.filter(F.col("date") != date).unionByName(rebuilt, allowMissingColumns=True)


def last_write_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of several rows for one key keep the one written last."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    )


def write_memory(observations: DataFrame, memories: DataFrame) -> DataFrame:
    """Set summary and delta of observations; memories without any text change nothing."""
    useful = memories.filter(
        (F.col("observation_id") != 0) & ~(is_blank("summary") & is_blank("delta_summary"))
    ).select(
        "observation_id",
        clean("summary").alias("_summary"),
        clean("delta_summary").alias("_delta"),
    )
    hit = F.col("_summary").isNotNull()
    return (
        observations.join(useful, "observation_id", "left")
        .withColumn("summary", F.when(hit, F.col("_summary")).otherwise(F.col("summary")))
        .withColumn("delta_summary", F.when(hit, F.col("_delta")).otherwise(F.col("delta_summary")))
        .select(*observations.columns)
    )


def merge_payloads(first: DataFrame, retry: DataFrame) -> DataFrame:
    """Per label, non-blank fields of the retry win over the first reply."""
    fields = ["briefing", "delta_summary"]
    left, right = first.alias("f"), retry.alias("r")
    merged = left.join(right, F.col("f.canonical_label") == F.col("r.canonical_label"), "full")
    return merged.select(
        F.coalesce("f.canonical_label", "r.canonical_label").alias("canonical_label"),
        *[
            F.coalesce(non_blank(f"r.{name}"), non_blank(f"f.{name}"), F.lit("")).alias(name)
            for name in fields
        ],
    )


def missing_payloads(stories: DataFrame, payloads: DataFrame) -> DataFrame:
    """Stories whose reply has no text yet."""
    answered = payloads.filter(~is_blank("briefing")).select("canonical_label")
    return stories.join(answered, "canonical_label", "left_anti")
