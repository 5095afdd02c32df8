"""Connected components of a table of links, by alternating star contraction.

Every round is two aggregations and two joins over the links left; nothing is collected but
one checksum row a round. A round turns chains into stars, so the number of rounds grows
with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import settle


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(
        moved.select(F.col("m").alias("a"), "b")
    )


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a < b").groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def component_roots(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node in ``links (a, b)``; root is the smallest node reachable.

    Links with a null end and loops are no links. Raises if ``max_rounds`` don't suffice.
    """
    links = settle(
        _distinct(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    )
    before = _state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = settle(_distinct(_small_star(_distinct(_large_star(links)))))
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        links.select("a", "a").distinct()
    )
