"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``d`` bits share at least ``8 - d`` bytes in
place. A posting list holds the distinct fingerprints that agree in one choice of ``8 - d``
byte positions, so a pair is met exactly when its tally of shared positional bytes reaches
that guaranteed minimum; what is met is verified bit by bit. A list fixes ``8 - d`` bytes,
so it can't hold more than ``256 ** d`` fingerprints, whatever the size of a group of
copies: exact copies were collapsed before. Lists yield a spanning forest of their links,
which keeps all reachability without writing all pairs.

Defined cases: a null text is empty; a text without words has fingerprint zero and links
like any other; repeated rows and repeated doc_ids are kept; a null doc_id never names a
component unless all of its component's are null; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from storyloom.llm.components import component_roots
from storyloom.llm.shared import settle, whole_text

HASH_SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Of a text's runs of words, in order; a text of fewer words is one."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), HASH_SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    return np.fromiter(map(xxh64_intdigest, grams, repeat(HASH_SEED)), np.uint64, n)


def fingerprint(text: bytes, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the shingles' hashes, repeats included."""
    n = len(hashes)
    if n <= 1:
        return int(hashes[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(
            hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp): 64-bit fingerprints as signed longs."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("text_hash", T.LongType()),
            T.StructField("fp", T.LongType()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(
                (fingerprint(x.as_py(), shingle) for x in batch.column("text")),
                np.uint64,
                batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(values.view(np.int64)),
                ],
                names=["doc_id", "text_hash", "fp"],
            )

    return docs.select(
        "doc_id",
        F.xxhash64(whole_text()).alias("text_hash"),
        F.encode(whole_text(), "UTF-8").alias("text"),
    ).mapInArrow(score, schema)


def _masks(bits: int) -> list[np.uint64]:
    """Every change of at most ``bits`` bits of 64."""
    flips = []
    for n in range(1, bits + 1):
        flips += [sum(1 << b for b in chosen) for chosen in combinations(range(64), n)]
    return [np.uint64(x) for x in flips]


def list_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of a posting list."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def join(i: int, j: int) -> None:
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((int(fps[i]), int(fps[j])))

    if len(fps) <= 64:
        plain = [int(x) for x in fps]
        for i, x in enumerate(plain):
            for j in range(i + 1, len(plain)):
                if (x ^ plain[j]).bit_count() <= max_bits:
                    join(i, j)
        return links
    fps = np.sort(fps)
    spread = np.bitwise_or.reduce(fps ^ fps[0])
    for mask in _masks(max_bits):
        if mask & ~spread:  # changes a bit in which the whole list agrees
            continue
        other = fps ^ mask
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        for i in np.flatnonzero((fps[at] == other) & (fps < other)):
            join(int(i), int(at[i]))
    return links


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``max_bits`` bits of each other."""
    choices = [
        sum(0xFF << 8 * b for b in chosen) for chosen in combinations(range(8), 8 - max_bits)
    ]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in choices]
    index = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x).cast("long")) for x in signed])),
    ).withColumnsRenamed({"pos": "choice", "col": "shared"})
    index = index.repartition("choice", "shared").sortWithinPartitions("choice", "shared")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = [
                batch.column(c).to_numpy(zero_copy_only=False)
                for c in ("choice", "shared", "fp")
            ]
            part = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else part
            # The last list may go on in the next batch.
            last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in part]
            yield _links_of_lists([x[:cut] for x in part], max_bits)
        if held:
            yield _links_of_lists(held, max_bits)

    return index.mapInArrow(scan, "a long, b long")


def _links_of_lists(part: list[np.ndarray], max_bits: int) -> pa.RecordBatch:
    choice, shared, fp = part
    links: list[tuple[int, int]] = []
    if len(fp):
        starts = np.flatnonzero(
            np.r_[True, (choice[1:] != choice[:-1]) | (shared[1:] != shared[:-1])]
        )
        ends = np.r_[starts[1:], len(fp)]
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            links += list_links(fp[s:e].view(np.uint64), max_bits)
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(ends[:, i])) for i in (0, 1)], names=["a", "b"]
    )


def _placed(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id); components are told apart by root."""
    marked = settle(fingerprints(docs, shingle))
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = component_roots(fingerprint_links(distinct, max_bits))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # Fingerprints of a group of exact copies are one row here.
    named = settle(placed.join(least, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable."""
    return _placed(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one for each component: that of its smallest doc_id.

    Where rows repeat that doc_id, the one with the smallest hash of its text stays. Rows
    without a doc_id can't be told apart, so they all stay.
    """
    placed = _placed(docs.where("doc_id IS NOT NULL"), shingle, max_bits)
    return keep_least(docs, placed.where("doc_id = component_id"))


def keep_least(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root in ``placed (doc_id, text_hash, root)``."""
    kept = settle(
        placed.groupBy("root", "doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("_kept"))
    )
    names = docs.columns
    stays = docs.join(
        kept,
        (docs["doc_id"] == kept["_kept"]["doc_id"])
        & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == kept["_kept"]["text_hash"]),
    )
    copies = kept["_kept"]["copies"]
    once = stays.where(copies == 1).select(*[docs[c] for c in names])
    again = stays.where(copies > 1).select(*[docs[c] for c in names])
    again = (
        again.groupBy("doc_id", F.xxhash64(whole_text()).alias("_hash"))
        .agg(F.first(F.struct(*names)).alias("_row"))
        .select("_row.*")
    )
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))
