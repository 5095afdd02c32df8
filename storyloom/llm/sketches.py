"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into 8 to 32 paragraphs whatever its size: a paragraph has at least a
power-of-two number of characters, its scale, and ends at the next sentence end, or at the
next white space if that is too far. A digest holds a hash of the paragraph (and of how
often it came before) and its length. Digests go into three cells each, and cells keep a
count and two exclusive-ors. Cells of two versions subtract; peeling cells with one digest
left recovers the paragraphs in which they differ. Cells to peel are rows, all those of a
document in one partition, so a round of peeling is an aggregation without a shuffle. If
peeling gets stuck, larger sketches are subtracted and peeled. Likeness is the share of characters in paragraphs that do not
differ, at the coarser of the two scales.

All of it is SQL functions. The next document is found by a window over ranges of doc_id,
each closed by a copy of the next range's first document.

Defined cases: a null text is empty; an empty text has no paragraphs, and two empty texts
have likeness one; null doc_ids come before all others; rows that repeat a doc_id follow
each other in order of their texts; a single row is followed by itself; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import settle, whole_text, width

# Cells per table, and a table per hash function. A text has about 32 paragraphs at most.
FINGERPRINT_CELLS = 8
PEEL_CELLS = (32, 128)
HASHES = 3
# Each round peels one table.
ROUNDS = 12

_LENGTH_BITS = 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scale(text: Column) -> Column:
    """Least number of characters of a paragraph: a power of two, a sixteenth of the text."""
    n = F.greatest(F.length(text), F.lit(16))
    return F.pow(F.lit(2), F.floor(F.log2(n / 16) + 1e-9)).cast("int")


def digests(text: Column, least: Column) -> Column:
    """The paragraphs' digests at a scale; low bits hold a paragraph's length."""
    size = least.cast("string")
    pattern = F.concat(
        F.lit("(?s).{1,"), size, F.lit(r"}(?:.{0,"), size, F.lit(r"}?(?:[.!?](?=\s)|\n|\z)|.*?(?:\s|\z))")
    )
    mask = (1 << _LENGTH_BITS) - 1

    def digest(units: Column) -> Column:
        def one(unit: Column, at: Column) -> Column:
            before = F.size(F.filter(F.slice(units, F.lit(1), at), lambda x: x == unit))
            return F.xxhash64(unit, before).bitwiseAND(F.lit(~mask)).bitwiseOR(
                F.least(F.length(unit), F.lit(mask)).cast("long")
            )

        return F.transform(units, one)

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), digest)


def _length(digest: Column) -> Column:
    return digest.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))


def _place(digest: Column, table: int, cells: int) -> Column:
    """The cell of a digest in one of the tables."""
    return F.shiftrightunsigned(digest, _LENGTH_BITS + 14 * table).bitwiseAND(
        F.lit(cells - 1).cast("long")
    )


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def _combine(cells: Column, items: Column) -> Column:
    """``cells`` with items (place, n, k, c) added in."""
    return F.transform(
        cells,
        lambda cell, at: F.aggregate(
            F.filter(items, lambda x: x["p"] == at),
            cell,
            lambda acc, x: _cell(acc["n"] + x["n"], acc["k"].bitwiseXOR(x["k"]), acc["c"].bitwiseXOR(x["c"])),
        ),
    )


def _tables(of: Callable[[int], Column]) -> Column:
    return F.struct(*[of(j).alias(f"t{j}") for j in range(HASHES)])


def sketch(keys: Column, cells: int) -> Column:
    """Tables t0, t1, ... of cells (count, xor of digests, xor of checks)."""
    empty = F.array_repeat(_cell(F.lit(0), F.lit(0), F.lit(0)), cells)

    def table(j: int) -> Column:
        items = F.transform(
            keys,
            lambda d: F.struct(
                _place(d, j, cells).cast("int").alias("p"),
                F.lit(1).alias("n"),
                d.alias("k"),
                _check(d).alias("c"),
            ),
        )
        return _let(items, lambda found: _combine(empty, found))

    return _tables(table)


def _signed_cells(one: Column, other: Column, cells: int) -> Column:
    """Cell entries of one list's digests, and of the other's with the sign turned."""

    def entries(keys: Column, j: int, sign: int) -> Column:
        return F.transform(
            keys,
            lambda d: F.struct(
                F.lit(j).alias("t"),
                _place(d, j, cells).cast("int").alias("p"),
                F.lit(sign).cast("long").alias("n"),
                d.alias("k"),
                _check(d).alias("c"),
                F.lit(0).cast("long").alias("chars"),
            ),
        )

    return F.concat(
        *[entries(keys, j, sign) for keys, sign in ((one, 1), (other, -1)) for j in range(HASHES)]
    )


def _sum_cells(rows: DataFrame) -> DataFrame:
    """Entries of a cell added up; empty cells go. Table -1 holds what was recovered."""
    return (
        rows.groupBy("row", "pair", "t", "p")
        .agg(
            F.sum("n").alias("n"),
            F.bit_xor("k").alias("k"),
            F.bit_xor("c").alias("c"),
            F.sum("chars").alias("chars"),
        )
        .where("n <> 0 OR k <> 0 OR c <> 0 OR t = -1")
    )


def _peel_round(rows: DataFrame, j: int, cells: int) -> DataFrame:
    """Takes the cells of table j that hold one digest: in one table none is met twice."""
    n, k, c = F.col("n"), F.col("k"), F.col("c")
    pure = (F.col("t") == j) & (F.abs(n) == 1) & (c == _check(k))

    def entry(table: int, place: Column, n: Column, k: Column, c: Column, chars: Column) -> Column:
        return F.struct(
            F.lit(table).alias("t"),
            place.cast("int").alias("p"),
            n.alias("n"),
            k.alias("k"),
            c.alias("c"),
            chars.alias("chars"),
        )

    zero = F.lit(0).cast("long")
    leaves = [
        entry(i, _place(k, i, cells), -n, k, c, zero) for i in range(HASHES) if i != j
    ]
    recovered = entry(-1, F.lit(0), zero, zero, zero, _length(k))
    same = F.struct("t", "p", "n", "k", "c", "chars")
    turned = F.when(pure, F.array(*leaves, recovered)).otherwise(F.array(same))
    return _sum_cells(rows.select("row", "pair", F.inline(turned)))


def differing_characters(pairs: DataFrame, cells: int) -> DataFrame:
    """(row, pair, chars, stuck) of pairs (row, pair, one, other) that differ at all.

    ``chars`` are those of the recovered digests of both lists; ``stuck`` says that some
    could not be recovered from sketches of this size. Rows of a document share a partition.
    """
    rows = pairs.repartition(width(pairs.sparkSession), "row").select(
        "row", "pair", F.inline(_signed_cells(F.col("one"), F.col("other"), cells))
    )
    rows = _sum_cells(rows)
    for number in range(ROUNDS):
        rows = _peel_round(rows, number % HASHES, cells)
    return rows.groupBy("row", "pair").agg(
        F.sum("chars").alias("chars"), F.max((F.col("t") >= 0).cast("int")).alias("stuck")
    )


def differences(pairs: DataFrame) -> DataFrame:
    """(row, pair, chars) of pairs that differ: peeled, in larger sketches where stuck."""
    found = None
    left = pairs
    for cells in PEEL_CELLS:
        peeled = settle(differing_characters(left, cells))
        done = peeled.where("stuck = 0").select("row", "pair", "chars")
        found = done if found is None else found.union(done)
        left = left.join(peeled.where("stuck = 1").select("row", "pair"), ["row", "pair"], "left_semi")
    # Digests that share their cells in every size: compare the lists themselves.
    either = F.array_union(
        F.array_except("one", "other"), F.array_except("other", "one")
    )
    return found.union(left.select("row", "pair", _characters(either).alias("chars")))


def _characters(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, d: acc + _length(d))


def likeness(one: Column, other: Column, differing: Column) -> Column:
    total = _characters(one) + _characters(other)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.coalesce(differing, F.lit(0).cast("long")) / total
    )


def fingerprint(keys: Column, least: Column) -> Column:
    """Scale, characters and cells as text."""
    tables = sketch(keys, FINGERPRINT_CELLS)
    cells = F.transform(
        _let(tables, lambda t: F.concat(*[t[f"t{j}"] for j in range(HASHES)])),
        lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"])),
    )
    return F.concat_ws(
        "|", least.cast("string"), _characters(keys).cast("string"), F.lower(F.array_join(cells, ";"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): every document with the text of the one after it."""
    spark = docs.sparkSession
    own = docs.select("doc_id", whole_text().alias("text"))
    ranges = width(spark)
    points = [i / ranges for i in range(1, ranges)]
    splits = (
        sorted(set(own.agg(F.percentile_approx("doc_id", points, 10 * ranges).alias("s")).first()["s"] or []))
        if points
        else []
    )
    inside = F.coalesce(F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col("doc_id"))), F.lit(0)) if splits else F.lit(0)
    own = own.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(inside))
    # One row per range; a null doc_id is the smallest.
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id")))
    firsts = own.groupBy("range").agg(least.alias("first")).orderBy("range").collect()
    closing = [
        (firsts[i - 1]["range"], row["first"]["id"]) for i, row in enumerate(firsts)
    ]  # the range before the first one is the last
    if not closing:
        return own.select("doc_id", "text", F.col("text").alias("next"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = F.broadcast(spark.createDataFrame(closing, f"before int, first {kind}"))
    copies = own.join(marks, F.col("doc_id").eqNullSafe(F.col("first"))).select(
        "doc_id", "text", F.col("before").alias("range"), F.lit(1).alias("closes")
    )
    rows = own.select("doc_id", "text", "range", F.lit(0).alias("closes")).union(copies)
    order = Window.partitionBy("range").orderBy("closes", F.asc_nulls_first("doc_id"), "text")
    return rows.withColumn("next", F.lead("text").over(order)).where("closes = 0").select("doc_id", "text", "next")


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses; see the module text."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    # Built-in digests of the three texts; the texts themselves end here.
    texts = with_next(docs).withColumn("edited", edited).withColumns(
        {"s": scale(F.col("text")), "s_edited": scale(F.col("edited")), "s_next": scale(F.col("next"))}
    )

    def at(text: str, own: str, other: str) -> Column:
        """Digests at the coarser of two scales, where that is not the text's own."""
        return F.when(F.col(own) < F.col(other), digests(F.col(text), F.col(other)))

    keys = settle(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            "s",
            "s_edited",
            digests(F.col("text"), F.col("s")).alias("k"),
            digests(F.col("edited"), F.col("s_edited")).alias("k_edited"),
            F.when(F.col("s_next") >= F.col("s"), digests(F.col("next"), F.col("s_next")))
            .otherwise(digests(F.col("next"), F.col("s")))
            .alias("k_next"),
            at("text", "s", "s_edited").alias("k_as_edited"),
            at("edited", "s_edited", "s").alias("k_edited_as"),
            at("text", "s", "s_next").alias("k_as_next"),
        )
    )
    edited_pair = F.coalesce("k_as_edited", "k"), F.coalesce("k_edited_as", "k_edited")
    next_pair = F.coalesce("k_as_next", "k"), F.col("k_next")
    pairs = keys.select(
        "row",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("pair"), one.alias("one"), other.alias("other"))
                    for i, (one, other) in enumerate((edited_pair, next_pair))
                ]
            )
        ),
    )
    differing = (
        differences(pairs)
        .groupBy("row")
        .agg(*[F.sum(F.when(F.col("pair") == i, F.col("chars"))).alias(f"d{i}") for i in (0, 1)])
    )
    return keys.join(differing, "row", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("k"), F.col("s")).alias("fingerprint"),
        fingerprint(F.col("k_edited"), F.col("s_edited")).alias("edited_fingerprint"),
        likeness(*edited_pair, F.col("d0")).alias("near_edited"),
        likeness(*next_pair, F.col("d1")).alias("near_next"),
    )
