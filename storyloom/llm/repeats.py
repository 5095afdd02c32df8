"""Removal of long byte strings that repeat, by sorting suffixes in sampled range partitions.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting
every suffix is not needed: each string is chosen by one anchor (``byte_runs``), and a run of
strings with one anchor is a suffix to sort, with the hash of its anchor gram as leading
token and that of all its bytes as the next.

1. Runs are range-partitioned by sampled splitters, sorted in their buckets by multikey
   quicksort and compared with their neighbours, across bucket boundaries too. A run whose
   anchor is found nowhere else has no repeated string. One that is found as a whole again
   repeats in all its strings.
2. Of the others, the strings themselves (leading bytes, then a hash of all) are sorted and
   compared in the same way, with those of one copy of each whole run of the same anchor.

Splitters also divide equal suffixes by their places, so a passage that many documents share
fills as many buckets as it needs. Hashes have 64 bits, checked along with leading bytes or
anchors.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; repeated
rows lose all their bytes if they are long enough; null doc_ids are kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.byte_runs import Hashes, runs
from storyloom.llm.shared import settle, whole_text, width

GRAM_SHARE = 0.6  # of the length: grams that choose the anchors

_EMIT = 1 << 16
_ROWS = 500  # documents handled at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few documents: what is made of them is passed on before more is made."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _packed(docs: DataFrame) -> DataFrame:
    """(d, doc_id, packed): a key of the row and its text, compressed for shuffles."""
    schema = T.StructType(
        [T.StructField("d", T.LongType()), docs.schema["doc_id"], T.StructField("packed", T.BinaryType())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in _slices(batches):
            packed = [squeeze.compress(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("doc_id"), pa.array(packed, pa.binary())],
                names=["d", "doc_id", "packed"],
            )

    return _keyed(docs).mapInArrow(pack, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        F.xxhash64("doc_id", text).alias("d"), "doc_id", F.encode(text, "UTF-8").alias("text")
    )


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, _EMIT):
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[at : at + _EMIT]) for x in columns.values()], names=list(columns)
        )


def _all_runs(docs: DataFrame, length: int) -> DataFrame:
    """(g, w, d, s, n): anchor hash, run hash, document, first string and number of strings."""
    gram = int(length * GRAM_SHARE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            parts = []
            for d, text in zip(batch.column("d").to_pylist(), batch.column("text"), strict=True):
                s, n, g, w = runs(text.as_py(), length, gram)
                parts.append((g.view(np.int64), w.view(np.int64), np.full(len(s), d), s, n))
            if parts:
                g, w, d, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield from _batches({"g": g, "w": w, "d": d, "s": s, "n": n.astype(np.int32)})

    return _keyed(docs).where(F.octet_length("text") >= length).select("d", "text").mapInArrow(
        read, "g long, w long, d long, s long, n int"
    )


def multikey_order(tokens: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Multikey quicksort: sort by the first token, then only what is tied by the next one.

    Returns the order, and after each token the number of the group of equal rows.
    """
    order = np.argsort(tokens[0], kind="quicksort")
    groups = []
    group = np.zeros(len(order), np.int64)
    for level, token in enumerate(tokens):
        if level:
            sizes = np.bincount(group)
            tied = np.flatnonzero(sizes[group] > 1)
            inner = np.lexsort((token[order[tied]], group[tied]))
            order[tied] = order[tied][inner]
        ordered = token[order]
        new = (ordered[1:] != ordered[:-1]) | (group[1:] != group[:-1])
        group = np.r_[0, np.cumsum(new)] if len(order) else group
        groups.append(group)
    return order, groups


def _sorted_buckets(suffixes: DataFrame, first: str, second: str, place: str, only: str | None) -> DataFrame:
    """``suffixes`` that equal a neighbour in their sorted bucket, or may across its ends.

    Adds ``same1`` and ``same2`` (equal in the first token, in both), ``lead2`` (first of its
    equals in the bucket), ``edge1`` and ``edge2`` (equal to the bucket's first or last) and
    ``bucket``. Rows that are none of these are left out, as are those without ``only``.
    """
    names = suffixes.columns
    schema = T.StructType(
        [
            *suffixes.schema,
            *[T.StructField(n, T.BooleanType()) for n in ("same1", "same2", "lead2", "edge1", "edge2")],
            T.StructField("bucket", T.IntegerType()),
        ]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not sum(len(x[0]) for x in held):
            return
        rows = dict(zip(names, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
        held.clear()
        order, (one, both) = multikey_order([rows[first], rows[second]])
        size1, size2 = np.bincount(one), np.bincount(both)
        marks = {
            "same1": size1[one] > 1,
            "same2": size2[both] > 1,
            "lead2": np.r_[True, both[1:] != both[:-1]],
            "edge1": (one == 0) | (one == one[-1]),
            "edge2": (both == 0) | (both == both[-1]),
        }
        keep = marks["same1"] | marks["edge1"]
        if only:
            # One row of each edge always stays, to be met by the bucket beside it.
            asked = rows[only][order]
            keep = (marks["same2"] & asked) | marks["edge2"]
        chosen = order[keep]
        out = {n: rows[n][chosen] for n in names} | {n: m[keep] for n, m in marks.items()}
        out["bucket"] = np.full(len(chosen), TaskContext.get().partitionId(), np.int32)
        yield from _batches(out)

    buckets = width(suffixes.sparkSession)
    return suffixes.repartitionByRange(buckets, first, second, place).mapInArrow(compare, schema)


def _across(marked: DataFrame, keys: list[str], edge: str, name: str) -> DataFrame:
    """Adds ``name``: whether a row's equals lie in several buckets.

    Such suffixes are the first or last of two buckets: two a bucket at most.
    """
    found = (
        marked.where(edge)
        .groupBy(*keys)
        .agg((F.min("bucket") < F.max("bucket")).alias(name))
        .where(name)
    )
    return marked.join(F.broadcast(found), keys, "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def _strings(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(lead, h, place, open): the strings of runs; place is the run's number and the string's."""
    by_doc = asked.groupBy("d").agg(
        F.collect_list(F.struct("s", "n", "run", "open")).alias("asked")
    )  # runs of one document
    rows = by_doc.join(_packed(docs).select("d", "packed"), "d").select("asked", "packed")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            for asked, packed in zip(batch.column("asked"), batch.column("packed"), strict=True):
                data = np.frombuffer(loosen.decompress(packed.as_py()), np.uint8)
                for run in asked.as_py():
                    s, n = run["s"], run["n"]
                    part = data[s : s + n + length - 1]
                    h = Hashes(part).fixed(length).view(np.int64)
                    lead = np.lib.stride_tricks.sliding_window_view(part, 8)[:n]
                    lead = np.ascontiguousarray(lead).view(">i8").ravel().astype(np.int64)
                    yield lead, h, (run["run"] << 12) + np.arange(n), np.full(n, run["open"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in read(batches):
            held.append(part)
            size += len(part[0])
            if size >= _EMIT:
                yield from _joined(held)
                held, size = [], 0
        if held:
            yield from _joined(held)

    return rows.mapInArrow(emit, "lead long, h long, place long, open boolean")


def _joined(held: list) -> Iterator[pa.RecordBatch]:
    return _batches(
        dict(zip(("lead", "h", "place", "open"), (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
    )


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(d, s, n): strings of ``length`` bytes from s to s+n-1 that repeat."""
    if not 8 <= length <= 4000:
        raise ValueError("length must lie between 8 and 4000")
    found = settle(_all_runs(docs, length))
    marked = settle(_sorted_buckets(found, "g", "w", "d", None))
    marked = _across(_across(marked, ["g"], "edge1", "across1"), ["g", "w"], "edge2", "across2")
    marked = marked.where("same1 OR across1").select(
        "g", "d", "s", "n", "lead2", (F.col("same2") | F.col("across2")).alias("whole")
    )
    survivors = settle(marked.withColumn("run", F.monotonically_increasing_id()))
    single = survivors.where("NOT whole")
    open_anchors = single.select("g").distinct()
    copies = survivors.where("whole AND lead2").join(open_anchors, "g", "left_semi")
    asked = single.select("d", "s", "n", "run", F.lit(True).alias("open")).union(
        copies.select("d", "s", "n", "run", F.lit(False).alias("open"))
    )
    strings = _strings(asked, docs, length)
    met = settle(_sorted_buckets(strings, "lead", "h", "place", "open"))
    met = _across(met, ["lead", "h"], "edge2", "across2").where("open AND (same2 OR across2)")
    part = met.select(
        F.shiftright("place", 12).alias("run"), F.col("place").bitwiseAND(4095).alias("at")
    )
    of_runs = single.select("run", "d", "s").join(part, "run")
    return survivors.where("whole").select("d", "s", F.col("n").cast("long").alias("n")).union(
        of_runs.select("d", (F.col("s") + F.col("at")).alias("s"), F.lit(1).cast("long").alias("n"))
    )


def covered(n_bytes: int, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which bytes are covered by the strings that start in the given stretches."""
    change = np.zeros(n_bytes + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256); kept holds the other bytes."""
    repeats = (
        repeated_starts(docs, length)
        .groupBy("d")
        .agg(F.collect_list(F.struct("s", "n")).alias("found"))  # stretches of one document
    )
    rows = _packed(docs).join(repeats, "d", "left").select("doc_id", "packed", "found")
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept", T.BinaryType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            out: list[tuple] = []
            for packed, found in zip(batch.column("packed"), batch.column("found"), strict=True):
                data = loosen.decompress(packed.as_py())
                n, removed, spans, kept = len(data), 0, 0, data
                if found.is_valid:
                    starts = found.values.field("s").to_numpy()
                    sizes = found.values.field("n").to_numpy()
                    gone = covered(n, starts, sizes, length)
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((n, removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, kept, digest = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(x, pa.int64()) for x in (n, removed, spans)],
                    pa.array(kept, pa.binary()),
                    pa.array(digest, pa.string()),
                ],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(cut, schema)
