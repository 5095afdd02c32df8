"""Token ids in flat binary files with 64-bit document offsets.

A folder holds, for every shard, ``tokens-*.bin`` (the ids of its documents one after the
other, each document closed by the end id, as unsigned little-endian integers of 16 bits, or
32 where the vocabulary needs them), ``offsets-*.bin`` (unsigned 64-bit little-endian: where
each document starts among the ids of *all* shards, and the end of the last) and
``names-*.arrow`` (their doc_ids). ``manifest.json`` names the files of each shard in order,
with its first offset: the prefix sum of the shards before it. Files are memory-mapped where
the folder is a mounted path, and read by range elsewhere.

Documents are in ascending doc_id order: they are dealt and sorted by ranges of (doc_id, hash
of the text, row), so that no id, null included, has to fit one task, and encoded as they are
written. Files carry the name of the attempt that wrote them and only those that the
manifest names count; a task that runs twice leaves a file that nobody reads, removed at the
end.

Defined cases: a null text is empty; an empty text has the end id alone; null doc_ids come
first; rows with one doc_id are in the order of a hash of their texts; repeated rows are
written each; an empty table makes a folder without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.shared import settle, whole_text, width

END_ID = 0

# Pieces whose ids one Python worker holds; of a full cache only those just met stay. Longer
# pieces are not held.
CACHE_PIECES = 500_000
CACHED_CHARS = 64

# Texts encoded at a time.
BLOCK = 500

# Texts of these characters only are split here, as byte-level BPE does; any other text goes
# through the tokenizer as a whole.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"
)


class ByteTokenizer:
    """Token ids of whole texts as the bytes of the files, cached by piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        self.largest = max(vocabulary.values(), default=0)
        self.code = np.dtype("<u2" if self.largest < 1 << 16 else "<u4")
        self._opens_piece = np.zeros(self.largest + 1, bool)
        # The sign for a space opens a piece and stands nowhere else in it.
        self._opens_piece[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self._ids: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, self.code).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        spaced = [p for p in pieces if p[0] == " " and len(p) > 1 and not p.isspace()]
        raw = self.whole("".join(spaced))
        ids = np.frombuffer(raw, self.code)
        starts = (self.code.itemsize * np.flatnonzero(self._opens_piece[ids])).tolist()
        rest = pieces
        if len(starts) == len(spaced):
            ends = [*starts, len(raw)][1:]
            for piece, at, stop in zip(spaced, starts, ends, strict=True):
                self._ids[piece] = raw[at:stop]
            rest = [p for p in pieces if p not in self._ids]
        found = self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        for piece, encoding in zip(rest, found, strict=True):
            self._ids[piece] = np.array(encoding.ids, self.code).tobytes()

    def _plain(self, text: str) -> bool:
        try:
            simple = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            return False
        return simple and not any(a in text for a in self._added)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self._ids
        for at in range(0, len(texts), BLOCK):
            block = texts[at : at + BLOCK]
            pieces = [_PIECE.findall(t) if self._plain(t) else None for t in block]
            here = set().union(*(p for p in pieces if p))
            if len(known) > CACHE_PIECES:  # what this block has stays
                recent = {p: known[p] for p in here if p in known}
                known.clear()
                known.update(recent)
            new = here.difference(known)
            self._learn([p for p in new if len(p) <= CACHED_CHARS])
            for text, found in zip(block, pieces, strict=True):
                if found is None:
                    yield self.whole(text)
                    continue
                try:
                    yield b"".join(map(known.__getitem__, found))
                except KeyError:  # a piece too long to be held
                    yield b"".join(known[p] if p in known else self.whole(p) for p in found)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, by its URI, and the path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def _write_shards(ordered: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Write ids, local lengths and names; (shard, attempt, n_docs, n_tokens) of each shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        system, root = place(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        end = np.array([END_ID], tokenizer.code).tobytes()
        item = len(end)
        lengths, n_tokens, out, names = array("Q"), 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = system.open_output_stream(f"{root}/tokens-{attempt}.bin")
                sink = system.open_output_stream(f"{root}/names-{attempt}.arrow")
                names = pa.ipc.new_file(sink, pa.schema([("doc_id", batch.column("doc_id").type)]))
            for at in range(0, batch.num_rows, BLOCK):
                for raw in tokenizer.encode(batch.column("text").slice(at, BLOCK).to_pylist()):
                    out.write(raw + end)
                    lengths.append(len(raw) // item + 1)
                    n_tokens += len(raw) // item + 1
            names.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id")], names=["doc_id"]))
        if out is None:
            return
        out.close()
        names.close()
        sink.close()
        with system.open_output_stream(f"{root}/lengths-{attempt}.bin") as file:
            file.write(np.array(lengths, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "attempt": attempt, "n_docs": len(lengths), "n_tokens": n_tokens}],
            schema=pa.schema([("shard", pa.int32()), ("attempt", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return ordered.select("doc_id", "text").mapInArrow(write, "shard int, attempt string, n_docs long, n_tokens long")


def _shard_rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    rows = [(s["attempt"], s["base"], s["n_docs"], s["n_tokens"]) for s in shards]
    made = spark.createDataFrame(rows, "attempt string, base long, n_docs long, n_tokens long")
    return made.repartition(max(1, min(len(rows), 4 * width(spark))))


def _write_offsets(shards: DataFrame, folder: str) -> DataFrame:
    """Offsets among the ids of all shards: the shard's base and the sums of its lengths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{root}/lengths-{row['attempt']}.bin") as file:
                    lengths = np.frombuffer(file.read(), "<u8")
                offsets = np.r_[np.uint64(0), np.cumsum(lengths)].astype("<u8") + np.uint64(row["base"])
                with system.open_output_stream(f"{root}/offsets-{row['attempt']}.bin") as file:
                    file.write(offsets.tobytes())
            yield batch.select(["attempt"])

    return shards.mapInArrow(write, "attempt string")


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str) -> dict:
    """Encode all documents into ``folder``; returns the manifest."""
    spark = docs.sparkSession
    system, root = place(folder)
    system.create_dir(root, recursive=True)
    order = ["doc_id", "tie", "row"]
    named = docs.select(
        "doc_id",
        F.xxhash64(whole_text()).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        whole_text().alias("text"),
    )
    ordered = named.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    # One row for each shard comes to the driver, here and below.
    rows = settle(_write_shards(ordered, tokenizer_path, folder)).orderBy("shard").collect()
    shards, base = [], 0
    for r in rows:
        shards.append({"attempt": r["attempt"], "base": base, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        base += r["n_tokens"]
    if shards:
        _write_offsets(_shard_rows(spark, shards), folder).count()
    named = {s["attempt"] for s in shards}
    for info in system.get_file_info(pafs.FileSelector(root)):
        kind, _, attempt = info.base_name.partition("-")
        if kind in ("tokens", "names", "offsets", "lengths"):
            if kind == "lengths" or attempt.split(".")[0] not in named:
                system.delete_file(info.path)
    code = _tokenizer(tokenizer_path).code.str
    manifest = {"dtype": code, "n_tokens": base, "n_docs": sum(s["n_docs"] for s in shards), "shards": shards}
    with system.open_output_stream(f"{root}/manifest.json") as file:
        file.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """One shard's files, memory-mapped where they can be."""

    def __init__(self, folder: str, shard: dict, code: str) -> None:
        system, root = place(folder)
        self.base, self.item = shard["base"], np.dtype(code).itemsize
        local = isinstance(system, pafs.LocalFileSystem)
        with system.open_input_file(f"{root}/offsets-{shard['attempt']}.bin") as file:
            self.offsets = np.frombuffer(file.read(), "<u8").astype(np.int64)
        name = f"{root}/tokens-{shard['attempt']}.bin"
        self.file = pa.memory_map(name) if local else system.open_input_file(name)
        self.code = code
        with system.open_input_file(f"{root}/names-{shard['attempt']}.arrow") as file:
            table = pa.ipc.open_file(file).read_all()
        self.names = table.column("doc_id")
        whole = (len(self.names), self.file.size(), int(self.offsets[0]))
        if whole != (len(self.offsets) - 1, (int(self.offsets[-1]) - self.base) * self.item, self.base):
            raise ValueError(f"files of {shard['attempt']} disagree: {whole}")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of the shard's documents first..last-1, in one array."""
        at = (int(self.offsets[first]) - self.base) * self.item
        stop = (int(self.offsets[last]) - self.base) * self.item
        return np.frombuffer(self.file.read_at(stop - at, at), self.code)


def read_tokens(spark: SparkSession, folder: str, id_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ids as little-endian unsigned 32-bit bytes."""
    system, root = place(folder)
    with system.open_input_stream(f"{root}/manifest.json") as file:
        manifest = json.loads(file.read())
    code = manifest["dtype"]
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row, code)
                for first in range(0, row["n_docs"], BLOCK):
                    last = min(first + BLOCK, row["n_docs"])
                    offsets = shard.offsets[first : last + 1]
                    raw = shard.ids(first, last).astype("<u4").tobytes()
                    bounds = (4 * (offsets - offsets[0])).tolist()
                    ids = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays(shard.names.slice(first, last - first).chunks),
                            pa.array(offsets[:-1]),
                            pa.array(np.diff(offsets)),
                            pa.array(ids, pa.binary()),
                        ],
                        names=schema.names,
                    )

    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    return _shard_rows(spark, manifest["shards"]).mapInArrow(read, schema)


def token_digests(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files written to ``folder``."""
    write_tokens(docs, tokenizer_path, folder)
    found = read_tokens(docs.sparkSession, folder, docs.schema["doc_id"].dataType)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
