"""Place names in text.

A folded text is cut into pieces: runs of a-z and 0-9, and every other character by itself.
A name stands in a text as whole words exactly when it starts at a piece and ends where no
letter or digit goes on. One walk over the pieces offers each as the start of a name, with
what follows it; the names are found by joining those starts with a table of names on the
first piece, whatever the number of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.constants import GAZETTEER, GLOBAL_KEYWORDS
from storyloom.functions.text import contains_any, fold

_WORD = "[a-z0-9]"
_GAZETTEER = "place_rank bigint, label string, lat double, lon double, scope string, alias string"


def pieces(folded: Column | str) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"{_WORD}+|[^a-z0-9]"), F.lit(0))


def gazetteer_table(spark: SparkSession, gazetteer=GAZETTEER) -> DataFrame:
    """(place_rank, label, lat, lon, scope, alias), a row for each name of a place."""
    return spark.createDataFrame(
        [
            (rank, label, float(lat), float(lon), scope, alias)
            for rank, (label, lat, lon, scope, aliases) in enumerate(gazetteer)
            for alias in aliases
        ],
        _GAZETTEER,
    )


def name_table(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer with each name's first piece and number of pieces; blank names go."""
    named = gazetteer.withColumn("alias", fold("alias")).where("alias <> ''")
    return named.withColumn("_pieces", pieces("alias")).select(
        "*", F.col("_pieces")[0].alias("first"), F.size("_pieces").alias("length")
    ).drop("_pieces")


def name_starts(piece_column: str, longest: int, firsts: list[str] | None = None) -> Column:
    """Array of (at, first, inside, rest): each piece, and it with what follows it.

    ``rest`` has one piece more than the longest name, to see whether a word goes on.
    ``inside`` says that a letter or digit stands right before the piece. Where ``firsts``
    are known, other pieces are left out before anything is put together.
    """
    listed = F.col(piece_column)
    starts = F.transform(listed, lambda piece, i: F.struct(i.alias("at"), piece.alias("first")))
    keep = (lambda s: s["first"] != " ") if firsts is None else (lambda s: s["first"].isin(firsts))
    return F.transform(
        F.filter(starts, keep),
        lambda s: F.struct(
            s["at"].alias("at"),
            s["first"].alias("first"),
            F.coalesce(F.get(listed, s["at"] - 1).rlike(_WORD), F.lit(False)).alias("inside"),
            F.array_join(F.slice(listed, s["at"] + 1, longest + 1), "").alias("rest"),
        ),
    )


def starts_with_name(start: str, alias: str) -> Column:
    """Whether the name stands at a start (a struct of ``name_starts``) as whole words."""
    rest, name = F.col(f"{start}.rest"), F.col(alias)
    word_after = F.substring(rest, F.length(name) + 1, F.lit(1)).rlike(_WORD)
    word_first = F.substring(name, 1, 1).rlike(_WORD)
    return F.startswith(rest, name) & ~word_after & (word_first | ~F.col(f"{start}.inside"))


def mentions_global(text: Column, keywords: list[str] = GLOBAL_KEYWORDS) -> Column:
    return contains_any(text, keywords)


def article_place_text(title: Column | str, description: Column | str) -> Column:
    return fold(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
