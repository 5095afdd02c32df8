"""Outputs of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_daily_snapshot(labeled: DataFrame, path: str, date: str) -> None:
    """The labeled batch as JSON under its date; a re-run replaces that date."""
    (
        labeled.withColumn("date", F.lit(date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("date")
        .json(path)
    )


def write_lines(lines: DataFrame, path: str, order: list[Column]) -> None:
    """Report lines as text files in reading order (file names sort the parts)."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
