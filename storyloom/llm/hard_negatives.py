"""Hard negatives by exact scores from subset-sum tables.

An anchor's components are cut into groups of eight; for each group a table holds the sum of
every subset of its components. A candidate's components, in two's complement, are cut into
bit planes, and each plane's eight bits of a group are one byte: the place of a subset in the
group's table. The inner product is the sum of those entries over groups, shifted by the
plane's weight and added over planes (the sign plane is taken off).

Anchors go to the tasks in blocks of bounded size; each block passes over the candidates
twice: once for the positives of its anchors, once for the negatives that the positives'
scores allow. A task keeps a few rows per anchor, or per anchor and positive, of what it
read; those are merged by ranks. A block's result is written before the next block starts.

Defined cases: rows whose label, vector or vec_id is null, or whose vector holds a null, NaN
or infinite component take no part; vectors of unequal length score over the components they
share, an empty one scores 0; an anchor's own vec_id is never its positive or negative;
repeated rows are each a candidate; an anchor id that repeats is asked once for each of its
labels, with its largest vector; anchors without positives, and positives without negatives
that fit, give no rows; components end at the bounds of 32 bits, so that scores fit 64; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import new_folder, settle

GROUP = 8
CANDIDATE_BLOCK = 4096

# Bytes of tables that one block of anchors may take in a task.
TABLE_BYTES = 64 << 20

_MOST = 2**31 - 1

ROWS = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def labelled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, weights): components x as floor(scale * x), labels moved on where the id is divisible by 7."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").where(fit)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(_MOST)), F.lit(-_MOST))).alias("weights"),
    )


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, byte, anchor): for each group of eight components, the sum of each subset."""
    n, width = anchors.shape
    groups = -(-width // GROUP)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :width] = anchors
    by_group = padded.reshape(n, groups, GROUP)
    tables = np.zeros((groups, 1 << GROUP, n), np.int64)
    for bit in range(GROUP):  # subsets with this bit: those without it, and one component more
        half = 1 << bit
        tables[:, half : 2 * half, :] = tables[:, :half, :] + by_group[:, :, bit].T[:, None, :]
    return tables.astype(np.int32) if np.abs(tables).max(initial=0) < 2**31 else tables


def planes_needed(rows: np.ndarray) -> int:
    """Bits of two's complement that hold all components."""
    if not rows.size:
        return 1
    return max(int(rows.max()).bit_length(), int(~rows.min()).bit_length() if rows.min() < 0 else 0) + 1


def bit_planes(rows: np.ndarray, planes: int) -> np.ndarray:
    """(plane, group, row): the eight bits of a group of components as one byte."""
    n, width = rows.shape
    groups = -(-width // GROUP)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :width] = rows
    bits = np.stack([(padded >> plane) & 1 for plane in range(planes)]).astype(np.uint8)
    packed = np.packbits(bits.reshape(planes, n, groups, GROUP), axis=3, bitorder="little")
    return packed[:, :, :, 0].transpose(0, 2, 1)


def table_scores(tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(row, anchor): inner products by lookups, shifts and additions alone."""
    planes = planes_needed(rows)
    packed = bit_planes(rows, planes)
    # All sums on the way stay below this.
    largest = int(np.abs(tables).max(initial=0)) * max(1, tables.shape[0]) << planes
    kind = np.int32 if largest < 2**31 else np.int64
    tables = tables.astype(kind, copy=False)
    scores = np.zeros((len(rows), tables.shape[2]), kind)
    for plane in range(planes):
        looked_up = np.zeros_like(scores)
        for group in range(tables.shape[0]):
            looked_up += tables[group][packed[plane, group]]
        looked_up <<= plane
        if plane == planes - 1:
            scores -= looked_up
        else:
            scores += looked_up
    return scores


def _fitted(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : min(len(row), width)] = row[:width]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], tables: np.ndarray, width: int) -> Iterator[tuple]:
    """(ids, labels, scores (anchor x row)) of blocks of candidates."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
            part = batch.slice(at, CANDIDATE_BLOCK)
            lists = pa.concat_arrays([part.column("weights")])
            sizes = np.diff(lists.offsets.to_numpy())
            if len(sizes) and (sizes == width).all():
                rows = lists.flatten().to_numpy().reshape(len(sizes), -1)
            else:
                rows = _fitted(lists.to_pylist(), width)
            scores = np.ascontiguousarray(table_scores(tables, rows).T)
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), scores


class First:
    """The first few (score, then smaller id) rows of each slot so far."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        none = np.empty(0, np.int64)
        self.ids, self.scores = [none] * slots, [none] * slots

    def add(self, slot: int, ids: np.ndarray, scores: np.ndarray) -> None:
        held = self.scores[slot]
        if len(held) == self.k:
            better = scores >= held[-1]
            ids, scores = ids[better], scores[better]
        if not len(ids):
            return
        if len(ids) > 4 * self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= edge], scores[scores >= edge]
        ids, scores = np.concatenate([self.ids[slot], ids]), np.concatenate([held, scores])
        order = np.lexsort((ids, ~scores))[: self.k]
        self.ids[slot], self.scores[slot] = ids[order], scores[order]

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id, score) of all rows held."""
        none = np.empty(0, np.int64)
        slots = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        return slots, np.concatenate([none, *self.ids]), np.concatenate([none, *self.scores])


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], names=list(columns))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class AnchorBlock:
    """Anchors of one block, sent to the tasks that read the candidates."""

    def __init__(self, candidates: DataFrame, anchors: list) -> None:
        self.candidates, self.spark = candidates, candidates.sparkSession
        self.width = max(len(r["weights"]) for r in anchors)
        weights = _fitted([r["weights"] for r in anchors], self.width)
        self.ids = np.array([r["vec_id"] for r in anchors], np.int64)
        self.labels = np.array([r["label"] for r in anchors], np.int64)
        self.shared = self.spark.sparkContext.broadcast((self.ids, self.labels, weights))

    def positives(self, k: int) -> DataFrame:
        """(anchor, vec_id, score): the first k other rows with the anchor's label."""
        shared, width = self.shared, self.width

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, weights = shared.value
            first, nobody = First(len(ids), k), np.empty(0, np.int64)
            for vec_ids, own, scores in _blocks(batches, subset_sums(weights), width):
                with_label = {x: np.flatnonzero(own == x) for x in np.unique(own).tolist()}
                for a, (anchor, label) in enumerate(zip(ids.tolist(), labels.tolist(), strict=True)):
                    like = with_label.get(label, nobody)
                    like = like[vec_ids[like] != anchor]
                    first.add(a, vec_ids[like], scores[a, like].astype(np.int64))
            slot, vec_id, score = first.columns()
            yield _table(anchor=slot, vec_id=vec_id, score=score)

        found = self.candidates.mapInArrow(scan, "anchor long, vec_id long, score long")
        return _ranked(found, ["anchor"], k).drop("rank")

    def negatives(self, positives: list, k: int, low: int, high: int) -> DataFrame:
        """(slot, rank, vec_id, score): the first k rows of other labels each positive allows.

        low * positive_score <= high * negative_score <= high * positive_score.
        """
        shared, width = self.shared, self.width
        by_anchor: dict[int, list[tuple[int, int]]] = {}
        for slot, r in enumerate(positives):
            by_anchor.setdefault(r["anchor"], []).append((slot, r["score"]))
        # The least score allowed, rounded up: low * p / high.
        wanted = {
            a: [(slot, -(-low * p // high), p) for slot, p in mine if low * p <= high * p]
            for a, mine in by_anchor.items()
        }
        wanted = {a: mine for a, mine in wanted.items() if mine}
        asked = self.spark.sparkContext.broadcast((wanted, len(positives)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, weights = shared.value
            wanted, slots = asked.value
            first = First(slots, k)
            for vec_ids, own, scores in _blocks(batches, subset_sums(weights), width):
                for a, mine in wanted.items():
                    row = scores[a]
                    least, most = min(x[1] for x in mine), max(x[2] for x in mine)
                    fit = np.flatnonzero((row >= least) & (row <= most))
                    fit = fit[(own[fit] != labels[a]) & (vec_ids[fit] != ids[a])]
                    if not len(fit):
                        continue
                    near, values = vec_ids[fit], row[fit].astype(np.int64)
                    for slot, low_score, high_score in mine:
                        chosen = (values >= low_score) & (values <= high_score)
                        first.add(slot, near[chosen], values[chosen])
            slot, vec_id, score = first.columns()
            yield _table(slot=slot, vec_id=vec_id, score=score)

        return _ranked(self.candidates.mapInArrow(scan, "slot long, vec_id long, score long"), ["slot"], k)

    def mine(self, path: str, n_positives: int, n_negatives: int, low: int, high: int) -> None:
        """Add the block's rows to the table at ``path``."""
        # At most n_positives rows for each anchor of the block.
        positives = self.positives(n_positives).collect()
        named = self.spark.createDataFrame(
            [(i, int(self.ids[r["anchor"]]), r["vec_id"], r["score"]) for i, r in enumerate(positives)],
            "slot long, anchor_id long, positive_id long, positive_score long",
        )
        found = self.negatives(positives, n_negatives, low, high)
        # Bounded like the positives.
        found.join(F.broadcast(named), "slot").select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
        self.shared.destroy()


def mine_negatives(
    vectors: DataFrame,
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    block_rows: int = 2048,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; ``block_rows`` bounds how many
    are held by the driver and a task at once, and wide vectors lower it.
    """
    spark = vectors.sparkSession
    candidates = settle(labelled_vectors(vectors, scale))
    anchors = (
        candidates.where(F.col("vec_id") % every == 0)
        .groupBy("vec_id", "label")
        .agg(F.max("weights").alias("weights"))
    )
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("width")).first()
    per_anchor = 8 * (1 << GROUP) * -(-max(1, size["width"] or 1) // GROUP)
    blocks = -(-size["n"] // max(1, min(block_rows, TABLE_BYTES // per_anchor)))
    path = new_folder(spark)
    for number in range(blocks):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id", "label"), F.lit(blocks)) == number).collect()
        if mine:
            AnchorBlock(candidates, mine).mine(path, n_positives, n_negatives, low, high)
    if not blocks:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(path)
