"""Skip reasons, per-source cap and URL deduplication of feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.ranking import top_per_group


def skip_report(items: DataFrame) -> DataFrame:
    """Items per skip reason and source, plus one total per reason.

    A null source marks a total. Rows that are kept are not part of the report.
    """
    per_source = items.groupBy("skip_reason", "source").agg(F.count("*").alias("items"))
    return (
        per_source.rollup("skip_reason", "source")
        .agg(F.sum("items").alias("items"))
        .filter(F.col("skip_reason").isNotNull())
    )


def cap_per_source(
    items: DataFrame, cap: int | None, keys: list[str] = ["source"], position: str = "item_pos"
) -> DataFrame:
    """First ``cap`` items of every source in feed order."""
    if cap is None:
        return items
    return top_per_group(items, keys, [F.col(position)], cap, "_rank").drop("_rank")


def first_per_key(items: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """Earliest row per key; partial aggregation keeps one row per key and task."""
    rest = [c for c in items.columns if c not in keys]
    return (
        items.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in items.columns])
    )
