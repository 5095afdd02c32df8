"""Documents to packed training sequences, stage by stage.

Each stage takes all rows of the one before it and returns rows with the columns of
documents; the last returns the pieces and their places. Nulls are read as the stages'
operators say: a null text is an empty document and stays one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import mixing, packing, pii, similar, toxicity
from storyloom.llm.shared import releasing, settle, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity of 0.8 or more connects, the smallest doc_id stays.

    SimHash fingerprints within two bits are met first, in the index of op6; what they can't
    see at 0.8 is found by an exact join.
    """
    return similar.keep_one(docs, shingle=5, least="0.8", max_bits=2)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce domains are repeated; none is dropped (the least rate is one)."""
    return mixing.mix(
        docs, table(spark, sf_dir, "labels"), ["quality", "toxic"], flatten=0.7, least_rate=1.0
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents take their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", unique),
    ("personal_data", masked),
    ("mixing", mixed),
    ("packing", packed),
]

# Trained scores, sketches and a tokenizer: SQL has none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again.

    What the stages settled on their way is removed at the end, but for the last result.
    """
    docs = table(spark, sf_dir, "documents")
    kept: list[DataFrame] = []
    with releasing(spark, kept):
        for _, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir))
        kept.append(docs)
    return docs
