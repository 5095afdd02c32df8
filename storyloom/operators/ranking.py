"""Top-k and numbering that stay spread out when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.session import cut

# Up to this k Spark prunes each group before the shuffle (WindowGroupLimit).
_PRUNED_K = 1000
_SALTS = 64


def _numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group, numbered from 1.

    For a small ``k`` each map task ships at most ``k`` rows per group. For a
    large one the same happens per salt, so a hot group is cut down in parallel.
    """
    if k > _PRUNED_K:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)))
        first = _numbered(salted, [*keys, "_salt"], order, "_first")
        df = first.filter(F.col("_first") <= k).drop("_first", "_salt")
    return _numbered(df, keys, order, name).filter(F.col(name) <= k)


def positions(
    df: DataFrame,
    keys: list[str],
    ordinal: str = "ordinal",
    major: str | None = None,
    name: str = "position",
    width: int = 1_000_000,
) -> DataFrame:
    """Number the rows of every group from 1 by (``major``, ``ordinal``).

    Groups may be of any size: rows are numbered within slices of ``width``
    consecutive ordinals, and each slice starts after the rows of the slices
    before it. An ordinal occurs once per group, so a slice holds at most
    ``width`` rows; only slice counts are ever summed over a whole group.
    """
    slice_keys = [*keys, *([major] if major else []), "_slice"]
    slice_order = ([F.col(major)] if major else []) + [F.col("_slice")]
    sliced = df.withColumn("_slice", F.floor(F.col(ordinal) / width))
    before = Window.partitionBy(*keys).orderBy(*slice_order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        sliced.groupBy(*slice_keys)
        .agg(F.count("*").alias("_rows"))
        .select(*slice_keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    local = _numbered(sliced, slice_keys, [F.col(ordinal)], "_local")
    same = [local[c].eqNullSafe(starts[c]) for c in slice_keys]
    return local.join(starts, same).select(
        *[local[c] for c in df.columns],
        (F.col("_start") + F.col("_local")).cast("bigint").alias(name),
    )


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number all rows from 1 in the given order, without one task seeing them all.

    The rows are range-sorted and written once (so that partitions stay as they
    are); each partition then starts after the rows of the ones before it. Only
    one count per partition is summed in order.
    """
    placed = cut(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row per partition of the sort.
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_local") + 1).alias(name)
    )
