"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Queries are rows of a block of bounded size, sent to the tasks that read the candidates.
Each component is a term: its posting list holds the candidates with a nonzero weight there,
and every query with that term adds its weight times the list's weights into a dense row of
scores. A task keeps k per query of what it read (partition selection), and those are merged
per query. More queries mean more passes over the candidates, each with one block; a block's
result is written before the next block starts.

Defined cases: a vector that is null or holds a null, NaN or infinite component takes no
part; vectors of unequal length score over the components they share; a candidate is every
row but those with the query's own id; repeated rows are candidates each, and a query id
that repeats is asked once, with its largest vector; a null id takes no part; scores beyond 64
bits end at their bounds; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import new_folder

CANDIDATE_BLOCK = 4096

_RESULT = "query_id long, vec_id long, score long"
_RANKED = "query_id long, rank int, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, weights): every component x as floor(scale * x); unfit rows are left out."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id IS NOT NULL").where(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * scale)).alias("weights"),
    )


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : min(len(row), width)] = row[:width]
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all pairs, term by term."""
    largest = np.abs(queries.astype(float)).max(initial=0) * np.abs(candidates.astype(float)).max(initial=0)
    safe = largest * max(1, queries.shape[1]) < 2**62
    # Beyond 64 bits, exact numbers; else machine integers.
    kind = np.int64 if safe else object
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(queries.shape[1]):
        asked = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(candidates[:, term])
        if not len(asked) or not len(posting):
            continue
        weights = candidates[posting, term].astype(kind)
        whole = len(posting) == len(candidates)
        for q in asked.tolist():
            if whole:
                scores[q] += int(queries[q, term]) * weights
            else:
                scores[q, posting] += int(queries[q, term]) * weights
    if not safe:
        scores = np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)
    return scores


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(query_ids)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(query_ids)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for q, query_id in enumerate(self.query_ids.tolist()):
            row = scores[q]
            floor = self.scores[q][-1] if len(self.scores[q]) == self.k else None
            chosen = np.arange(len(row)) if floor is None else np.flatnonzero(row >= floor)
            chosen = chosen[ids[chosen] != query_id]
            if not len(chosen):
                continue
            if len(chosen) > 4 * self.k:  # partition selection; ties at the edge stay
                edge = np.partition(row[chosen], len(chosen) - self.k)[len(chosen) - self.k]
                chosen = chosen[row[chosen] >= edge]
            all_ids = np.concatenate([self.ids[q], ids[chosen]])
            all_scores = np.concatenate([self.scores[q], row[chosen]])
            order = np.lexsort((all_ids, ~all_scores))[: self.k]
            self.ids[q], self.scores[q] = all_ids[order], all_scores[order]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.query_ids, sizes)),
                pa.array(np.concatenate([*self.ids, np.empty(0, np.int64)])),
                pa.array(np.concatenate([*self.scores, np.empty(0, np.int64)])),
            ],
            names=["query_id", "vec_id", "score"],
        )


def _search(candidates: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = Best(ids, k)
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                lists = pa.concat_arrays([part.column("weights")])
                sizes = np.diff(lists.offsets.to_numpy())
                if len(sizes) and (sizes == queries.shape[1]).all():
                    matrix = lists.flatten().to_numpy().reshape(len(sizes), -1)
                else:
                    matrix = _matrix(lists.to_pylist(), queries.shape[1])
                best.add(part.column("vec_id").to_numpy(), accumulate(queries, np.ascontiguousarray(matrix)))
        yield best.rows()

    return candidates.mapInArrow(scan, _RESULT)


def top_k(
    vectors: DataFrame, every: int, k: int = 10, scale: int = 1024, block_rows: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``.

    ``block_rows`` bounds the queries held by the driver and a task at once.
    """
    spark = vectors.sparkSession
    candidates = integer_vectors(vectors, scale)
    asked = (
        candidates.where(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.max("weights").alias("weights"))
    )
    n = asked.count()
    blocks = -(-n // block_rows)
    path = new_folder(spark)
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number)
        rows = mine.collect()  # about block_rows rows
        if not rows:
            continue
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        queries = _matrix([r["weights"] for r in rows], max(len(r["weights"]) for r in rows))
        shared = spark.sparkContext.broadcast((ids, queries))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        (
            _search(candidates, shared, k)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
            .write.mode("append").parquet(path)
        )
        shared.destroy()  # one block at a time, on the driver and in the tasks
    if not n:
        return spark.createDataFrame([], _RANKED)
    return spark.read.schema(_RANKED).parquet(path)
