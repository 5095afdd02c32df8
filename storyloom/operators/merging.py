"""Merging the labels of a day into stories, with the false-merge guard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.constants import GENERIC_EVENT_TOKENS, LABEL_STOPWORDS, LABEL_TOKEN_ALIASES
from storyloom.functions.labels import (
    distinctive_tokens,
    is_generic_label,
    label_key,
    may_be_same_story,
)
from storyloom.session import cut

# Sorts labels nobody grouped behind every proposed group.
UNGROUPED = 1 << 62


class FirstFit:
    """Clusters of word sets, each set put into the first cluster it fits.

    A set fits a cluster when it shares a word with every set in it. The first cluster is
    there from the start and empty, so the first set goes there. The index has, for every
    word, the clusters that use it and which of their sets do (a bit mask); a set is tried
    only on clusters that share a word with it, and it fits where its words' masks cover all.
    """

    def __init__(self) -> None:
        self.sizes = [0]
        self._uses: dict[str, dict[int, int]] = {}

    def place(self, words: Sequence[str]) -> int:
        """The number of the cluster that takes the set."""
        cluster = 0
        if self.sizes[0]:
            covered: dict[int, int] = {}
            for word in words:
                for number, mask in self._uses.get(word, {}).items():
                    covered[number] = covered.get(number, 0) | mask
            fitting = (n for n, mask in covered.items() if mask.bit_count() == self.sizes[n])
            cluster = min(fitting, default=len(self.sizes))
        if cluster == len(self.sizes):
            self.sizes.append(0)
        for word in words:
            uses = self._uses.setdefault(word, {})
            uses[cluster] = uses.get(cluster, 0) | 1 << self.sizes[cluster]
        self.sizes[cluster] += 1
        return cluster


def _first_fit_rows(kinds: DataFrame, group: str) -> DataFrame:
    """(group, _key, cluster) of ``kinds`` (group, _key, first_pos, _tokens), group by group.

    A group comes sorted and in Arrow batches; its task holds the index, not the rows.
    """
    schema = T.StructType(
        [kinds.schema[group], kinds.schema["_key"], T.StructField("cluster", T.LongType())]
    )
    ordered = kinds.repartition(group).sortWithinPartitions(group, "first_pos", "_key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fit = object(), FirstFit()
        for batch in batches:
            clusters = []
            groups, sets = batch.column(group).to_pylist(), batch.column("_tokens").to_pylist()
            for name, words in zip(groups, sets, strict=True):
                if name != current:
                    current, fit = name, FirstFit()
                clusters.append(fit.place(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(group), batch.column("_key"), pa.array(clusters, pa.int64())],
                names=schema.names,
            )

    return ordered.mapInArrow(place, schema)


def label_clusters(
    members: DataFrame,
    group: str = "group_pos",
    generic: list[str] = GENERIC_EVENT_TOKENS,
    stopwords: list[str] = LABEL_STOPWORDS,
    aliases: dict[str, str] = LABEL_TOKEN_ALIASES,
) -> DataFrame:
    """Put each label of a proposed group into the first cluster it fits.

    ``members`` has (group, label_pos, label); the result adds ``cluster``. A
    label fits a cluster when the guard lets it join every label in it. Labels
    that name no generic event fit anywhere, so they go to cluster 0 without
    being looked at in order. Generic labels with the same distinctive words
    always end up together, so only distinct word sets are placed, in order of
    first use.
    """
    tokens = F.array_sort(distinctive_tokens("label", generic, stopwords, aliases))
    key = F.when(
        F.size("_tokens") > 0, F.concat(F.lit("words "), F.array_join("_tokens", " "))
    ).otherwise(F.concat(F.lit("label "), label_key("label")))
    keyed = (
        members.withColumn("_tokens", tokens)
        .withColumn("_key", F.when(is_generic_label("label", generic, aliases), key))
    )
    kinds = (
        keyed.filter(F.col("_key").isNotNull())
        .groupBy(group, "_key")
        .agg(F.min("label_pos").alias("first_pos"), F.first("_tokens").alias("_tokens"))
    )
    placed = _first_fit_rows(kinds, group)
    return (
        keyed.join(placed, [group, "_key"], "left")
        .withColumn("cluster", F.coalesce("cluster", F.lit(0)).cast("bigint"))
        .drop("_key", "_tokens")
    )


def name_clusters(
    clustered: DataFrame,
    group: str = "group_pos",
    generic: list[str] = GENERIC_EVENT_TOKENS,
    stopwords: list[str] = LABEL_STOPWORDS,
    aliases: dict[str, str] = LABEL_TOKEN_ALIASES,
) -> DataFrame:
    """Label each cluster: the proposal where it holds, else its first member.

    Expects ``canonical_label`` (the proposal) on every row; the result has one
    row per (group, cluster) with ``cluster_label``.
    """
    fits_all = F.bool_and(
        may_be_same_story("canonical_label", "label", generic, stopwords, aliases)
    )
    named = clustered.groupBy(group, "cluster").agg(
        F.first("canonical_label").alias("_proposal"),
        F.bool_or(F.col("label") == F.col("canonical_label")).alias("_is_member"),
        fits_all.alias("_fits_all"),
        F.min_by("label", "label_pos").alias("_first_label"),
    )
    split = named.groupBy(group).agg((F.count("*") > 1).alias("_split"))
    keeps = ~F.col("_split") | F.col("_is_member") | F.col("_fits_all")
    return named.join(split, group).select(
        group,
        "cluster",
        F.when(keeps, F.col("_proposal")).otherwise(F.col("_first_label")).alias("cluster_label"),
    )


def group_members(labels: DataFrame, proposals: DataFrame) -> DataFrame:
    """Labels of each proposal that exist today, in proposed order.

    ``proposals`` has (group_pos, canonical_label, labels). A label listed twice
    counts twice.
    """
    listed = proposals.select(
        "group_pos", "canonical_label", F.posexplode("labels").alias("label_pos", "label")
    )
    return listed.join(labels.select(F.col("story_label").alias("label")), "label").select(
        "group_pos", "canonical_label", F.col("label_pos").cast("bigint").alias("label_pos"), "label"
    )


def merge_labels(labels: DataFrame, proposals: DataFrame, **lists) -> DataFrame:
    """Today's labels -> story groups.

    ``labels`` has one row per (story_label, first_ordinal). The result has one
    row per placement: story_label, group_label and ``label_order``, the order in
    which placements add articles to their group. Labels in no proposal keep
    their own name.
    """
    clustered = cut(label_clusters(group_members(labels, proposals), **lists))
    named = name_clusters(clustered, **lists)

    def order(group: Column, cluster: Column, position: Column) -> Column:
        return F.struct(
            group.cast("bigint").alias("group"),
            cluster.cast("bigint").alias("cluster"),
            position.cast("bigint").alias("position"),
        ).alias("label_order")

    grouped = clustered.join(named, ["group_pos", "cluster"]).select(
        F.col("label").alias("story_label"),
        F.col("cluster_label").alias("group_label"),
        order(F.col("group_pos"), F.col("cluster"), F.col("label_pos")),
    )
    alone = labels.join(
        grouped.select("story_label").distinct(), "story_label", "left_anti"
    ).select(
        "story_label",
        F.col("story_label").alias("group_label"),
        order(F.lit(UNGROUPED), F.lit(0), F.col("first_ordinal")),
    )
    return grouped.unionByName(alone)
