"""Groups of documents whose shingle sets are alike: SimHash links first, then an exact join.

Fingerprints within a few bits meet in the positional index of ``simhash``; the pairs are
verified on the texts, and sets that they connect are not compared again. Fingerprints of
sets that are 0.8 alike differ in more bits, so a prefix-filtered join finds the rest.

Two sets of Jaccard similarity ``least`` or more share at least ``least`` of the larger one,
so under any one order of all shingles they share one of the first ``n - ceil(least * n) + 1``
of either's ``n``. The order is by the number of sets that hold a shingle, counted over all of
them; shingles of one set alone come first and need no list. So a set of which more than a
fifth is its own meets nobody, and the lists that are left are short. What meets in a list is
a pair only if what can follow there allows the similarity (positions in both sets bound it),
and is verified on the texts. No pair that is similar is missed.

Shingles that a good share of all sets holds (``HEAVY``) are found by their counts within
batches and come last in the order; they go to all tasks, so no posting list holds them
before it is cut to prefixes. There are at most 1 / HEAVY times the mean size of a set.

Only reachability is needed: sets first meet one member of each list, then more, drawn anew
every round (``HEADS``); then all pairs in a list that no links connect are verified.

Defined cases: a null text is empty; all texts without words are one group; a text of fewer
words than a shingle has one shingle, the whole; equal shingle sets are one set; repeated rows
and repeated doc_ids are kept apart by their texts, and of equal rows one stays; rows without a
doc_id all stay; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from storyloom.llm.components import component_roots
from storyloom.llm.shared import releasing, settle, whole_text
from storyloom.llm.simhash import HASH_SEED, fingerprint_links, fingerprint_of, keep_least, shingle_hashes

# Shingles of more than this share of all sets are heavy: 1 in so many. For the order alone.
HEAVY = 200
HEAVY_LEAST = 16

# Members of a list that meet all others, by round.
HEADS = (2, 4, 16)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def are_similar(one: np.ndarray, other: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    either = len(one) + len(other) - both
    return both * least.denominator >= either * least.numerator


def _node(found: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit number."""
    return int(np.uint64(xxh64_intdigest(found.tobytes(), HASH_SEED)).astype(np.int64))


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, n, key, fp): a row for each document, key null; and heavy ones.

    Rows with a key name a shingle that is heavy in a batch of sets, and n the sets there.
    """
    schema = T.StructType(
        [docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("text_hash", "node", "n", "key", "fp")]]
    )

    share, few = HEAVY // 2, HEAVY_LEAST * HEAVY // 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(x.as_py(), shingle) for x in batch.column("text")]
            fps = np.fromiter(map(fingerprint_of, hashes), np.uint64, len(hashes)).view(np.int64)
            sets = [np.unique(x) for x in hashes]
            nodes = [_node(s) for s in sets]
            sizes = [len(s) for s in sets]
            distinct = dict(zip(nodes, sets, strict=True)).values()
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *distinct]), return_counts=True)
            heavy = counts * share >= max(len(distinct), few)
            keys, counts = keys[heavy].view(np.int64), counts[heavy]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), none, pa.array(fps)],
                names=schema.names,
            )
            empty = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(keys), batch.schema.field("doc_id").type), empty, empty, pa.array(counts, pa.int64()), pa.array(keys), empty],
                names=schema.names,
            )

    return _bytes(docs).mapInArrow(read, schema)


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.xxhash64(whole_text()).alias("text_hash"), F.encode(whole_text(), "UTF-8").alias("text")
    )


def _heavy(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the heavy shingles, sorted, and their ranks in the order."""
    sets = marked.where("key IS NULL").select(F.approx_count_distinct("node")).first()[0]
    found = (
        marked.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.sum("n").alias("c"))
        .where(F.col("c") * HEAVY >= max(sets, HEAVY_LEAST * HEAVY))
        .orderBy("c", "key")
        .toArrow()
    )
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], order


def _postings(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], shingle: int) -> DataFrame:
    """(key, node, n, last): the light shingles of every set, n null; and a row for the set.

    The set's own row has its size and its heavy shingles in order; its key is the node.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = "key long, node long, n long, last array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                texts = batch.column("text").slice(first, 1000)
                sets = [shingle_set(x.as_py(), shingle) for x in texts]
                sets = {_node(s): s for s in sets}
                light, last = [], []
                for found in sets.values():
                    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                    is_heavy = keys[at] == found if len(keys) else np.zeros(len(found), bool)
                    order = np.argsort(ranks[at[is_heavy]])
                    last.append(found[is_heavy][order].view(np.int64).tolist())
                    light.append(found[~is_heavy])
                nodes = np.array(list(sets), np.int64)
                flat = np.concatenate([np.zeros(0, np.uint64), *light]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(flat),
                        pa.array(np.repeat(nodes, [len(x) for x in light])),
                        pa.nulls(len(flat), pa.int64()),
                        pa.nulls(len(flat), pa.list_(pa.int64())),
                    ],
                    names=["key", "node", "n", "last"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes),
                        pa.array(nodes),
                        pa.array([len(x) for x in sets.values()], pa.int64()),
                        pa.array(last, pa.list_(pa.int64())),
                    ],
                    names=["key", "node", "n", "last"],
                )

    return _bytes(docs).mapInArrow(read, schema)


def _counted(postings: DataFrame) -> DataFrame:
    """(node, key, c, n, last): shingles that c > 1 sets hold, and the sets' own rows (c null).

    Rows of one key come together, sorted; repeated ones (copies of a set) count once.
    """
    dealt = postings.repartition("key").sortWithinPartitions("key", "node")
    names = ["node", "key", "c", "n", "last"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = table.column("key").to_numpy()
            if not len(key):
                continue
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            held = table.slice(cut)
            yield from counted(table.slice(0, cut))
        if held is not None:
            yield from counted(held)

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = table.column("n").is_valid().to_numpy()
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        if not len(key):
            return
        # A set's own row may lie between postings of a shingle with the same number.
        rows = np.flatnonzero(~own)
        k, v = key[rows], node[rows]
        new = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])] if len(k) else np.zeros(0, bool)
        k, v = k[new], v[new]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        each = np.diff(np.r_[starts, len(k)])
        c = np.repeat(each, each)
        k, v, c = k[c > 1], v[c > 1], c[c > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v), pa.array(k), pa.array(c), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.list_(pa.int64()))],
            names=names,
        )
        at = np.flatnonzero(own)
        at = at[np.r_[True, node[at][1:] != node[at][:-1]]] if len(at) else at
        sets = table.take(pa.array(at))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node[at]),
                pa.nulls(len(at), pa.int64()),
                pa.nulls(len(at), pa.int64()),
                sets.column("n").combine_chunks(),
                sets.column("last").combine_chunks(),
            ],
            names=names,
        )

    return dealt.mapInArrow(scan, "node long, key long, c long, n long, last array<long>")


def _prefixes(counted: DataFrame, least: Fraction) -> DataFrame:
    """(key, node, n, place): the shared shingles in each set's prefix, place from 0.

    A set's list is as long as its text; what it has alone takes the first places.
    """
    sets = counted.groupBy("node").agg(
        F.max("n").alias("n"),
        F.first("last", ignorenulls=True).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("c", "key")))).alias("shared"),
    )
    alone = F.col("n") - F.size("shared") - F.size("last")
    size = F.col("n") - F.ceil(F.col("n") * least.numerator / F.lit(least.denominator)) + 1
    order = F.concat(F.col("shared.key"), F.col("last"))
    taken = F.slice(order, F.lit(1), F.greatest(F.lit(0), size - F.col("alone")).cast("int"))
    return (
        sets.withColumn("alone", alone)
        .where(size > F.col("alone"))
        .select("node", "n", "alone", F.posexplode(taken).alias("i", "key"))
        .select("key", "node", "n", (F.col("alone") + F.col("i")).alias("place"))
    )


def _shared_lists(prefixes: DataFrame) -> DataFrame:
    """(key, node, n, place) of the posting lists that hold more than one node."""
    index = prefixes.repartition("key").sortWithinPartitions("key")
    names = ["key", "node", "n", "place"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            part = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else part
            # The last list may go on in the next batch.
            cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            held = [x[cut:] for x in part]
            yield several([x[:cut] for x in part])
        if held:
            yield several(held)

    def several(part: list[np.ndarray]) -> pa.RecordBatch:
        key = part[0]
        same = key[1:] == key[:-1]
        kept = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in part], names=names)

    return index.mapInArrow(scan, "key long, node long, n long, place long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(a, b) of the pairs whose shingle sets are similar."""
    both = pairs.join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            kept = []
            for b, x, y in zip(*(batch.column(c) for c in ("b", "text_a", "text_b")), strict=True):
                if last[0] != b.as_py():
                    last = b.as_py(), shingle_set(y.as_py(), shingle)
                kept.append(are_similar(shingle_set(x.as_py(), shingle), last[1], least))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _possible(least: Fraction) -> Column:
    """Whether two sets that meet at their places in a list can be alike.

    From the first shingle that both hold they share at most what is left of either; the
    first of a pair's lists decides, later ones only ask less of what is left.
    """
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    up, down = least.numerator, least.denominator
    # Sharing s of n_a + n_b is similar where s * (down + up) >= up * (n_a + n_b).
    return (low * down >= high * up) & (left * (down + up) >= (low + high) * up)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _side(lists: DataFrame, name: str) -> DataFrame:
    return lists.select(
        "key",
        F.col("node").alias(name),
        F.col("n").alias(f"n_{name}"),
        F.col("place").alias(f"place_{name}"),
        F.col("root").alias(f"root_{name}"),
    )


def _likely(pairs: DataFrame, lists: DataFrame, least: Fraction) -> DataFrame:
    """The pairs that can be similar by what their prefixes share.

    Of the set whose prefix ends first, all shingles up to there that the other holds are in
    the other's prefix too: no pair shares more than its prefixes do and the longer rest.
    """
    up, down = least.numerator, least.denominator
    one = lists.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"))
    other = lists.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    shared = (
        pairs.join(one, "a")
        .join(other, ["key", "b"])
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("c"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    )
    # A prefix of n - ceil(least * n) + 1 leaves ceil(least * n) - 1.
    rest = F.floor((F.greatest("n_a", "n_b") * up + (down - 1)) / down) - 1
    # Sharing s of n_a + n_b is similar where s * (down + up) >= up * (n_a + n_b).
    return shared.where((F.col("c") + rest) * (down + up) >= (F.col("n_a") + F.col("n_b")) * up).select("a", "b")


def _apart(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists with the root of each node, without those that have one root alone."""
    roots = settle(component_roots(links))
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = (
        rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    )
    return settle(rooted.join(open_lists.select("key"), "key", "left_semi")), roots


def _fingerprint_pairs(marked: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): pairs that connect all sets whose fingerprints are within ``max_bits`` bits."""
    held = settle(marked.where("key IS NULL").select("fp", "node").distinct())
    first = settle(held.groupBy("fp").agg(F.min("node").alias("first")))
    links = fingerprint_links(first, max_bits)
    ends = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b"
    )
    same = held.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return _ordered(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).union(same))


def similar_roots(
    docs: DataFrame, marked: DataFrame, shingle: int, least: Fraction, max_bits: int = 2
) -> DataFrame:
    """(node, root) of all nodes that similar ones connect."""
    counted = settle(_counted(_postings(docs, _heavy(marked), shingle)))
    lists = settle(_shared_lists(_prefixes(counted, least)))
    met = lists.select("node").distinct()
    rows = (
        marked.where("key IS NULL")
        .join(met, "node", "left_semi")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
        .select("node", "row.doc_id", "row.text_hash")
    )
    texts = settle(_bytes(docs).join(rows, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text")))
    tried = settle(_fingerprint_pairs(marked, max_bits))
    links = settle(_verified(tried, texts, shingle, least))
    names = ["a", "b"]
    rooted, roots = _apart(lists, links)
    for number, n_heads in enumerate(HEADS):
        # Every list's members of the least draws meet all others of the list. First of all that
        # is the one with the fewest rarer shingles: copies have their changes to themselves,
        # so it is the nearest to what they were made from.
        random = [F.xxhash64("node", F.lit(number), F.lit(i)) for i in range(n_heads)]
        drawn = [F.col("place"), *random[1:]] if number == 0 else random
        draws = [
            F.min(F.struct(d.alias("d"), F.struct("node", "n", "place", "root").alias("x"))) for d in drawn
        ]
        heads = rooted.groupBy("key").agg(F.array(*draws).alias("head"))
        heads = heads.select("key", F.explode(F.array_distinct(F.col("head.x"))).alias("x")).select("key", "x.*")
        pairs = _side(rooted, "a").join(_side(heads, "b"), "key").where("root_a <> root_b").where(_possible(least))
        pairs = _ordered(pairs)
        new = settle(pairs.join(tried, names, "left_anti"))
        tried = tried.union(new)
        found = settle(_verified(settle(_likely(new, lists, least)), texts, shingle, least))
        links = links.union(found)
        rooted, roots = _apart(lists, links)
    pairs = _side(rooted, "a").join(_side(rooted, "b"), "key").where("a < b AND root_a <> root_b")
    rest = settle(_ordered(pairs.where(_possible(least))).join(tried, names, "left_anti"))
    if rest.isEmpty():
        return roots
    likely = settle(_likely(rest, lists, least))
    return component_roots(links.union(settle(_verified(likely, texts, shingle, least))))


def keep_one(docs: DataFrame, shingle: int = 5, least: str = "0.8", max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one for each group that similarity of ``least`` or more connects.

    Which one stays is settled as in ``simhash.keep_one``.
    """
    share = Fraction(least)
    known = docs.where("doc_id IS NOT NULL")
    placed: list[DataFrame] = []
    with releasing(docs.sparkSession, placed):  # pairs and postings go, the answer stays
        marked = settle(_marked(known, shingle))
        roots = similar_roots(known, marked, shingle, share, max_bits)
        rooted = marked.where("key IS NULL").join(roots, "node", "left")
        placed.append(settle(rooted.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))))
    return keep_least(docs, placed[0])
