"""Reading fields of model replies.

Replies are JSON text of unknown quality. They are read as VARIANT, because one
bad element must not void its whole array, and a field's JSON type has to be
known before its value is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.constants import (
    CLAIM_TYPES,
    DEFAULT_IMPORTANCE,
    DEFAULT_STORY_LABEL,
    DEFAULT_THEME,
    IMPORTANCE_RANGE,
    THEMES,
)
from storyloom.functions.text import as_col, fold, is_blank, strip

_WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def field(item: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


_TYPES = {
    "OBJECT": "^OBJECT",
    "ARRAY": "^ARRAY",
    "STRING": "^STRING$",
    "BOOLEAN": "^BOOLEAN$",
    "NUMBER": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
}


def is_type(value: Column, kind: str) -> Column:
    """Whether a VARIANT holds the given kind of JSON value; false when it is absent."""
    return F.coalesce(F.schema_of_variant(value).rlike(_TYPES[kind]), F.lit(False))


def string_field(item: Column, name: str) -> Column:
    """Stripped text of a string field; empty when it is anything else."""
    value = field(item, name)
    text = F.when(is_type(value, "STRING"), field(item, name, "string"))
    return strip(F.coalesce(text, F.lit("")))


def label_importance(item: Column) -> Column:
    """Whole number between 1 and 5; anything that is not a number counts as 1."""
    low, high = IMPORTANCE_RANGE
    value = field(item, "importance")
    text = field(item, "importance", "string")
    number = (
        F.when(is_type(value, "NUMBER"), field(item, "importance", "double"))
        .when(
            is_type(value, "STRING") & text.rlike(_WHOLE_NUMBER),
            F.trim(text).try_cast("double"),
        )
        .otherwise(F.lit(float(DEFAULT_IMPORTANCE)))
    )
    bounded = F.least(F.greatest(number, F.lit(float(low))), F.lit(float(high)))
    return F.coalesce(F.floor(bounded).cast("int"), F.lit(DEFAULT_IMPORTANCE))


def label_theme(item: Column, themes: list[str] = THEMES) -> Column:
    value = field(item, "theme")
    text = F.when(is_type(value, "STRING"), field(item, "theme", "string"))
    return F.when(text.isin(themes), text).otherwise(F.lit(DEFAULT_THEME))


def label_text(item: Column) -> Column:
    value = field(item, "story_label")
    text = field(item, "story_label", "string")
    falsy = (is_type(value, "NUMBER") & (field(item, "story_label", "double") == 0)) | (
        is_type(value, "BOOLEAN") & (text == "false")
    )
    kept = F.when(~falsy & ~is_blank(text), strip(text))
    return F.coalesce(kept, F.lit(DEFAULT_STORY_LABEL))


def claim_confidence(item: Column) -> Column:
    """A number (not a boolean) between 0 and 1, else null."""
    value = field(item, "confidence")
    number = F.when(is_type(value, "NUMBER"), field(item, "confidence", "double"))
    return F.when(number.between(0.0, 1.0), number)


def claim_entities(item: Column) -> Column:
    """Stripped names; null unless the field is a list of non-blank strings."""
    value = field(item, "entities")
    parts = F.when(is_type(value, "ARRAY"), field(item, "entities", "array<variant>"))
    named = F.forall(
        parts,
        lambda e: is_type(e, "STRING") & ~is_blank(F.try_variant_get(e, "$", "string")),
    )
    return F.when(
        named, F.transform(parts, lambda e: strip(F.try_variant_get(e, "$", "string")))
    )


def claim_fields(item: Column) -> list[Column]:
    """The fields of a proposed claim, each as a column of its own."""
    return [
        is_type(item, "OBJECT").alias("is_object"),
        string_field(item, "claim_text").alias("claim_text"),
        string_field(item, "claim_type").alias("claim_type"),
        claim_entities(item).alias("entities"),
        string_field(item, "evidence_span").alias("evidence_span"),
        claim_confidence(item).alias("confidence"),
    ]


def claim_reject_reason(folded_content: Column | str, claim_types: list[str] = CLAIM_TYPES) -> Column:
    """First rule the ``claim_fields`` of a row break; null for a claim to keep."""
    span = fold("evidence_span")
    return (
        F.when(~F.col("is_object"), F.lit("not_an_object"))
        .when(F.col("claim_text") == "", F.lit("empty_text"))
        .when(~F.col("claim_type").isin(claim_types), F.lit("unknown_type"))
        .when(F.col("entities").isNull(), F.lit("bad_entities"))
        .when(span == "", F.lit("empty_evidence"))
        .when(~F.contains(as_col(folded_content), span), F.lit("ungrounded_evidence"))
        .when(F.col("confidence").isNull(), F.lit("bad_confidence"))
    )
