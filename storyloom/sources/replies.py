"""Reply text -> rows, with everything unusable set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.replies import (
    field,
    is_type,
    label_importance,
    label_text,
    label_theme,
)
from storyloom.functions.text import clean, is_blank

# Room for the elements of one reply in the order over all replies.
_ITEMS_PER_REPLY = 1 << 32


def _parsed(replies: DataFrame, key: str) -> DataFrame:
    root = F.try_parse_json("reply")
    reason = (
        F.when(root.isNull(), F.lit("invalid_json"))
        .when(~is_type(root, "OBJECT"), F.lit("not_an_object"))
        .when(~is_type(field(root, key), "ARRAY"), F.lit("missing_list"))
    )
    return replies.withColumn("_root", root).withColumn("reject_reason", reason)


def reply_rejects(replies: DataFrame, key: str) -> DataFrame:
    """Replies that are not an object holding the named list, with the reason."""
    return _parsed(replies, key).filter(F.col("reject_reason").isNotNull()).drop("_root")


def reply_items(replies: DataFrame, key: str) -> DataFrame:
    """Elements of the named list, as VARIANT ``item`` with a running ``item_pos``.

    ``replies`` has (reply_no, reply) and any further columns, which are kept.
    """
    good = _parsed(replies, key).filter(F.col("reject_reason").isNull())
    kept = [c for c in replies.columns if c != "reply"]
    return good.select(
        *kept, F.posexplode(field(F.col("_root"), key, "array<variant>")).alias("_pos", "item")
    ).select(
        *kept, (F.col("reply_no") * _ITEMS_PER_REPLY + F.col("_pos")).alias("item_pos"), "item"
    )


def label_replies(replies: DataFrame) -> DataFrame:
    """(article_id, theme, story_label, importance); of several for an id the last."""
    item = F.col("item")
    rows = reply_items(replies, "results").filter(is_type(item, "OBJECT")).select(
        field(item, "id", "string").alias("article_id"),
        "item_pos",
        label_theme(item).alias("theme"),
        label_text(item).alias("story_label"),
        label_importance(item).alias("importance"),
    )
    last = F.max_by(F.struct("theme", "story_label", "importance"), "item_pos")
    return (
        rows.filter(F.col("article_id").isNotNull())
        .groupBy("article_id")
        .agg(last.alias("_row"))
        .select("article_id", "_row.*")
    )


def group_replies(replies: DataFrame) -> DataFrame:
    """(group_pos, canonical_label, labels) for proposals with a name and a list."""
    item = F.col("item")
    labels = field(item, "labels", "array<variant>")
    texts = F.transform(
        F.filter(labels, lambda v: is_type(v, "STRING")),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    return (
        reply_items(replies, "groups")
        .filter(is_type(item, "OBJECT") & is_type(field(item, "labels"), "ARRAY"))
        .select(
            F.col("item_pos").alias("group_pos"),
            clean(field(item, "canonical_label", "string")).alias("canonical_label"),
            texts.alias("labels"),
        )
        .filter(F.col("canonical_label") != "")
    )


def match_replies(replies: DataFrame) -> DataFrame:
    """(today_label, canonical_label); of several for a label the last."""
    item = F.col("item")

    def text(name: str) -> Column:
        return F.when(is_type(field(item, name), "STRING"), field(item, name, "string"))

    rows = reply_items(replies, "matches").filter(is_type(item, "OBJECT")).select(
        text("today_label").alias("today_label"),
        text("canonical_label").alias("canonical_label"),
        "item_pos",
    )
    return (
        rows.filter(F.col("today_label").isNotNull())
        .groupBy("today_label")
        .agg(F.max_by("canonical_label", "item_pos").alias("canonical_label"))
    )


def briefing_replies(replies: DataFrame) -> DataFrame:
    """(canonical_label, briefing, delta_summary); of several for a label and part the last.

    A story whose request came in parts has a reply for each, marked with its ``part`` (none
    means the first); their texts follow each other in part order.
    """
    item = F.col("item")

    def text(name: str) -> Column:
        return clean(field(item, name, "string"))

    delta = F.coalesce(F.nullif(text("delta_summary"), F.lit("")), text("delta"))
    rows = reply_items(replies, "briefings").filter(is_type(item, "OBJECT")).select(
        field(item, "canonical_label", "string").alias("canonical_label"),
        F.coalesce(field(item, "part", "bigint"), F.lit(0)).alias("part"),
        F.struct(text("briefing").alias("briefing"), delta.alias("delta_summary")).alias("_text"),
        "item_pos",
    )

    def merged(name: str) -> Column:
        texts = F.transform("_parts", lambda p: p["_text"][name])
        some = F.filter(texts, lambda t: ~is_blank(t))
        return F.when(F.size("_parts") == 1, texts[0]).otherwise(F.array_join(some, "\n\n")).alias(name)

    return (
        rows.filter(F.col("canonical_label").isNotNull())
        .groupBy("canonical_label", "part")
        .agg(F.max_by("_text", "item_pos").alias("_text"))
        .groupBy("canonical_label")
        # One entry a request part.
        .agg(F.sort_array(F.collect_list(F.struct("part", "_text"))).alias("_parts"))
        .select("canonical_label", merged("briefing"), merged("delta_summary"))
    )


def payload_replies(payloads: DataFrame) -> DataFrame:
    """Payloads keyed by label, each an object or bare text.

    ``payloads`` has (canonical_label, payload) with the payload as JSON text.
    """
    value = F.try_parse_json("payload")
    whole = F.try_variant_get(value, "$", "string")
    is_object = is_type(value, "OBJECT")
    delta = F.coalesce(
        F.nullif(clean(field(value, "delta_summary", "string")), F.lit("")),
        clean(field(value, "delta", "string")),
    )
    bare = F.when(is_blank(whole), F.lit("")).otherwise(clean(whole))
    return payloads.select(
        "canonical_label",
        F.when(is_object, clean(field(value, "briefing", "string"))).otherwise(bare).alias("briefing"),
        F.when(is_object, delta).otherwise(F.lit("")).alias("delta_summary"),
    )


def claim_replies(replies: DataFrame) -> DataFrame:
    """(article_id, claim_pos, item) of every usable reply; see ``reply_rejects``."""
    return reply_items(replies, "claims").withColumnRenamed("item_pos", "claim_pos")


def replied_articles(replies: DataFrame) -> DataFrame:
    """Articles with a usable claim reply, also one without any claim."""
    good = _parsed(replies, "claims").filter(F.col("reject_reason").isNull())
    return good.select("article_id").distinct()

