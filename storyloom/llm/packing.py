"""Best-fit packing of tokenized documents into sequences of a fixed length.

The plan is made over the histogram of piece lengths, not over documents: it has at most
``max_tokens`` lengths whatever the number of documents. Documents then take planned slots
by joining on (length, rank within length).

Defined cases: a null text is empty; an empty text is one piece holding only the end id;
repeated rows are packed each; a null doc_id is kept; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.shared import settle, whole_text, width

END_ID = b"\0\0\0\0"

# Entries of the cache of one Python worker; a full cache starts anew.
CACHE_WORDS = 250_000

# Texts encoded at a time.
BLOCK = 1000

# Texts of these characters only are lower-cased and split at white space here, and each
# word by the tokenizer's own rule (runs of letters, single digits, runs of other signs,
# English clitics): the tokenizer treats what stands between white space by itself. Any
# other text goes through the tokenizer as a whole.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, cached by word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._ids: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Cache the ids of words as they stand between white space."""
        known = self._ids
        parts = {w: _PART.findall(w) for w in words if not w.isalpha()}
        new = {w for w in words if w not in parts}
        new = list(new.union(*parts.values()).difference(known))
        ids = self._whole(" ".join(new))
        # Every part ends in the one token that closes it.
        stops = np.flatnonzero(self._ends_word[ids]) + 1
        if len(stops) == len(new) and (not len(new) or stops[-1] == len(ids)):
            raw, at = ids.tobytes(), 0
            for word, stop in zip(new, (4 * stops).tolist(), strict=True):
                known[word] = raw[at:stop]
                at = stop
        else:
            for word in new:
                known[word] = self._whole(word).tobytes()
        for word, found in parts.items():
            if word not in known:
                known[word] = b"".join(map(known.__getitem__, found))

    def _plain_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._ids) > CACHE_WORDS:
            self._ids.clear()
        found = list(map(self._ids.get, distinct))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            self._learn([distinct[i] for i in gaps])
            for i in gaps:
                found[i] = self._ids[distinct[i]]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.cumsum(each, dtype=np.int32)
        # Token by token: where its word's ids start, and how far into the word it is.
        at = np.repeat(starts[codes] - ends + each, each)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat.take(at)
        bounds = np.r_[0, ends][split.offsets.to_numpy()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        for at in range(0, len(texts), BLOCK):
            block = texts.slice(at, BLOCK)
            strings = block.to_pylist()
            plain = [_is_plain(s) and not any(a in s for a in self._added) for s in strings]
            quick = self._plain_ids(pa.concat_arrays([block.filter(pa.array(plain))]))
            for string, simple in zip(strings, plain, strict=True):
                yield (next(quick) if simple else self._whole(string)).tobytes()


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents, cut where longer than allowed."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[int] = []
            pieces, starts, lengths, sums = [], [], [], []
            for row, ids in enumerate(tokenizer.encode(batch.column("text"))):
                ids += END_ID
                for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at : at + 4 * max_tokens]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Open sequences with the same room left form runs of consecutive sequence numbers, so a
    length is placed run by run: its cost does not depend on the number of documents.
    Returns (length, first rank, end rank, first sequence, pieces per sequence, offset):
    ranks first..end-1 of that length go to consecutive sequences, ``pieces per sequence``
    in each, one after the other from ``offset``.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not runs.get(room):
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                rooms.pop(at)
            each = min(room // length, left)
            used = min(n, left // each)
            slots.append((length, rank, rank + used * each, first, each, capacity - room))
            put(room - each * length, first, used)
            put(room, first + used, n - used)
            rank += used * each
            left -= used * each
    return slots


def pack(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048
) -> DataFrame:
    """Pack all documents; see the module text.

    Ranks within a length are made per salt, so no length has to fit one task: counts by
    (length, salt) give each salt the rank it starts from.
    """
    spark = docs.sparkSession
    salted = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width(spark)))
    pieces = settle(token_pieces(docs, tokenizer_path, max_tokens)).withColumn("salt", salted)
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most max_tokens rows come to the driver.
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    slots = spark.createDataFrame(
        plan_slots(histogram, max_tokens),
        "length long, rank_from long, rank_to long, first_sequence long, each long, first_offset long",
    )
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within)).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("base"))
    step = F.col("rank") - F.col("rank_from")
    placed = ranked.join(
        # The plan is bounded by max_tokens lengths, a few runs each.
        F.broadcast(slots.withColumnRenamed("length", "slot_length")),
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("rank_from"))
        & (F.col("rank") < F.col("rank_to")),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
