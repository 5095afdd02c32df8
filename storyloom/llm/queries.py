"""The registered queries of this package, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import (
    drift_clusters,
    hard_negatives,
    html_text,
    language_model,
    mixing,
    packing,
    pii,
    repeats,
    simhash,
    sketches,
    token_files,
    topk,
    toxicity,
)
from storyloom.llm.shared import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op3_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.rates(docs, labels, ["quality", "toxic"], flatten=0.7, least_rate=0.0)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    # Bytes of a character that a removed stretch cut are not text: they turn into U+FFFD.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_versions(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_clusters.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), every=100)


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_model": op2_language_model,
    "op3_mixing_weights": op3_mixing_weights,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_html_main_text": op5_html_main_text,
    "op6_simhash_near_duplicates": op6_simhash_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_repeated_strings": op8_repeated_strings,
    "op9_fingerprints": op9_fingerprints,
    "op10_personal_data": op10_personal_data,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_token_files": op12_token_files,
    "op13_hard_negatives": op13_hard_negatives,
}
_NEAREST = """
placed{n} AS MATERIALIZED (
    SELECT vec_id, w, list_transform(c.cs, lambda c: CAST(list_sum(list_transform(range(1, 65),
               lambda i: (w[i] - c[i]) * (w[i] - c[i]))) AS BIGINT)) AS d
    FROM kept, cents{n} AS c
), near{n} AS MATERIALIZED (
    SELECT vec_id, w, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster,
           list_min(d) AS distance
    FROM placed{n}
)"""
_MOVED = """
, sums{n} AS (
    SELECT cluster, i, sum(x) AS s, count(*) AS c
    FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(w) AS x FROM near{n})
    GROUP BY cluster, i
), means{n} AS (
    SELECT cluster, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS w FROM sums{n} GROUP BY cluster
), cents{m} AS MATERIALIZED (
    SELECT list(coalesce(m.w, o.w) ORDER BY o.cluster) AS cs
    FROM (SELECT unnest(range(0, len(cs))) AS cluster, unnest(cs) AS w FROM cents{n}) AS o
    LEFT JOIN means{n} AS m ON m.cluster = o.cluster
),"""


def _clusters_sql(rounds: int = 3) -> str:
    steps = "".join(_NEAREST.format(n=n) + _MOVED.format(n=n, m=n + 1) for n in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cents0 AS MATERIALIZED (
    SELECT list(w ORDER BY h, w) AS cs
    FROM (SELECT sha256('1:' || vec_id) AS h, w FROM kept WHERE vec_id IS NOT NULL ORDER BY h, w LIMIT 16)
),{steps}{_NEAREST.format(n=rounds)}, whole AS (
    SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM near{rounds} GROUP BY cluster
)
SELECT n.vec_id, n.cluster, n.distance, t.cluster_inertia,
       (SELECT CAST(sum(distance) AS BIGINT) FROM near{rounds}) AS inertia,
       sha256(array_to_string((SELECT cs FROM cents{rounds})[n.cluster + 1], ',')) AS centroid_sha256
FROM near{rounds} AS n JOIN whole AS t ON t.cluster = n.cluster
"""


SQL: dict[str, str] = {
    "op11_centroid_clusters": _clusters_sql(),
    "op13_hard_negatives": """
WITH fit AS MATERIALIZED (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
           CAST(coalesce(list_sum(list_transform(range(1, least(len(a.w), len(c.w)) + 1),
                                                 lambda i: a.w[i] * c.w[i])), 0) AS BIGINT) AS score
    FROM fit AS a JOIN fit AS c ON a.vec_id <> c.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS MATERIALIZED (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
""",
    "op4_exact_top_k": """
WITH fit AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1),
                                        lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
    FROM fit AS q JOIN fit AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
