"""Cached labels, label replies and the false-merge guard."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.constants import LABEL_MODEL, LABEL_VERSION, THEMES
from storyloom.functions.labels import distinctive_tokens, is_generic_label, may_be_same_story
from storyloom.functions.stories import choose
from storyloom.functions.text import content_hash
from storyloom.operators.merging import label_clusters as cluster_labels
from storyloom.operators.merging import merge_labels
from storyloom.operators.tables import upsert
from storyloom.plans.labels import cached_labels
from storyloom.plans.labels import label as label_plan
from storyloom.plans.labels import label_requests as build_requests
from storyloom.queries import adapters as a
from storyloom.queries.registry import query
from storyloom.session import cut, run_folder
from storyloom.sources.state import StateStore
from storyloom.sources.replies import label_replies
from storyloom.sources.replies import reply_rejects as find_rejects

# Event nouns among the words of part names; the other nouns name no event.
PART_EVENTS = ["widget", "bolt", "ring", "gear", "rod"]
_REPLY_SIZE = 50


def label_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labels of the documents in ``labels``; some are for another text or model."""
    marks = a.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", "quality", "toxic"
    )
    doc = F.col("doc_id")
    return a.texts(spark, sf_dir).join(marks, "id").select(
        F.col("id").alias("article_id"),
        "url",
        "title",
        "description",
        content_hash(
            "title", F.when(doc % 7 == 0, F.lit("older text")).otherwise(F.col("description"))
        ).alias("content_hash"),
        F.when(F.col("toxic") == 1, F.lit("Climate")).otherwise(F.lit("Economy")).alias("theme"),
        F.concat(F.lit("stored "), (doc % 10).cast("string")).alias("story_label"),
        (F.col("quality") * 2 + 1).cast("int").alias("importance"),
        F.when(doc % 11 == 0, F.lit("older-model")).otherwise(F.lit(LABEL_MODEL)).alias("model"),
        F.when(doc % 13 == 0, F.lit("older-version")).otherwise(F.lit(LABEL_VERSION)).alias("version"),
    )


_CACHE = f"""{a.TEXTS},
cache AS (
  SELECT t.id AS article_id, t.url, t.title, t.description,
         sha256(t.title || chr(10) || CASE WHEN l.doc_id % 7 = 0 THEN 'older text'
                                           ELSE t.description END) AS content_hash,
         CASE WHEN l.toxic = 1 THEN 'Climate' ELSE 'Economy' END AS theme,
         'stored ' || (l.doc_id % 10) AS story_label, l.quality * 2 + 1 AS importance,
         CASE WHEN l.doc_id % 11 = 0 THEN 'older-model' ELSE '{LABEL_MODEL}' END AS model,
         CASE WHEN l.doc_id % 13 = 0 THEN 'older-version' ELSE '{LABEL_VERSION}' END AS version
  FROM texts t JOIN labels l ON l.doc_id = t.ordinal
),
hits AS (
  SELECT t.id, c.theme, c.story_label, c.importance
  FROM texts t JOIN cache c ON c.article_id = t.id
  WHERE c.model = '{LABEL_MODEL}' AND c.version = '{LABEL_VERSION}'
    AND c.content_hash = sha256(t.title || chr(10) || t.description)
)"""


def label_reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies for all documents, 50 elements each, with the faults replies have.

    Elements differ in the JSON type of the importance, name unknown themes or
    ids, lack a label, or come twice; some replies are not usable at all.
    """
    doc = F.col("doc_id")
    kind = doc % 10
    importance = (
        F.when(kind == 0, F.lit('"3"'))
        .when(kind == 1, F.lit("4.7"))
        .when(kind == 2, F.lit('"4.5"'))
        .when(kind == 3, F.lit("true"))
        .when(kind == 4, F.lit("null"))
        .when(kind == 5, F.lit("9"))
        .when(kind == 6, F.lit("-2"))
        .when(kind == 7, F.lit("[5]"))
        .otherwise((doc % 5 + 1).cast("string"))
    )
    themes = F.array(*[F.lit(t) for t in [*THEMES, "Weather"]])
    theme = F.element_at(themes, (doc % 10 + 1).cast("int"))
    label = choose(doc % 4, {0: '" "', 1: "0", 2: '" Story two "'}, '"Story three"')

    def element(ref: Column, story: Column) -> Column:
        return F.concat(
            F.lit('{"id":'), ref, F.lit(',"theme":"'), theme, F.lit('","story_label":'), story,
            F.lit(',"importance":'), importance, F.lit("}"),
        )

    own = F.when(doc % 6 == 0, doc.cast("string")).otherwise(
        F.concat(F.lit('"'), doc.cast("string"), F.lit('"'))
    )
    row = F.concat_ws(
        ",",
        F.when(doc % 9 == 0, element(own, F.lit('"first answer"'))),
        element(own, label),
        F.when(doc % 15 == 0, element(F.lit('"nobody"'), label)),
        F.when(doc % 14 == 0, F.lit('"no object"')),
    )
    batches = (
        a.table(spark, sf_dir, "documents")
        .select("doc_id", row.alias("row"))
        .groupBy(F.floor(doc / _REPLY_SIZE).alias("reply_no"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "row"))).alias("rows"))
    )
    results = F.array_join(F.transform("rows", lambda r: r["row"]), ",")
    return batches.select(
        "reply_no",
        F.when(F.col("reply_no") % 7 == 3, F.concat(F.lit('{"results":['), results))
        .when(F.col("reply_no") % 7 == 4, F.concat(F.lit("["), results, F.lit("]")))
        .when(F.col("reply_no") % 7 == 5, F.concat(F.lit('{"results":{"a":['), results, F.lit("]}}")))
        .otherwise(F.concat(F.lit('{"results":['), results, F.lit("]}")))
        .alias("reply"),
    )


_ANSWERS = f"""
answers AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN doc_id % 10 = 9 THEN 'Other'
              ELSE ({a._sql_list(THEMES)})[1 + doc_id % 10] END AS theme,
         CASE doc_id % 4 WHEN 2 THEN 'Story two' WHEN 3 THEN 'Story three'
                         ELSE 'Uncategorized' END AS story_label,
         CASE doc_id % 10 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 5 THEN 5 WHEN 8 THEN 1 + doc_id % 5
                          WHEN 9 THEN 1 + doc_id % 5 ELSE 1 END AS importance
  FROM documents WHERE floor(doc_id / {_REPLY_SIZE}) % 7 NOT IN (3, 4, 5)
)"""


@query(f"""
SELECT CAST(floor(doc_id / {_REPLY_SIZE}) AS BIGINT) AS reply_no,
       CASE floor(doc_id / {_REPLY_SIZE}) % 7 WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'not_an_object'
            ELSE 'missing_list' END AS reject_reason
FROM documents WHERE floor(doc_id / {_REPLY_SIZE}) % 7 IN (3, 4, 5)
GROUP BY ALL
""")
def reply_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that hold no list of results, with the reason."""
    rows = find_rejects(label_reply_texts(spark, sf_dir), "results")
    return rows.select("reply_no", "reject_reason")


@query(f"WITH {_ANSWERS} SELECT * FROM answers")
def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read from replies: checked theme, bounded importance, last answer kept."""
    answers = label_replies(label_reply_texts(spark, sf_dir)).withColumnRenamed("article_id", "id")
    return answers.join(a.texts(spark, sf_dir).select("id"), "id", "left_semi")


@query(f"WITH {_CACHE} SELECT id FROM texts WHERE id NOT IN (SELECT id FROM hits)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without a stored label for their present text."""
    rows = a.texts(spark, sf_dir)
    hits = cached_labels(rows, label_cache(spark, sf_dir))
    return rows.join(hits.select("id"), "id", "left_anti").select("id")


@query(f"""
WITH {_CACHE}, {_ANSWERS},
labeled AS (
  SELECT * FROM hits UNION ALL
  SELECT * FROM answers WHERE id NOT IN (SELECT id FROM hits)
)
SELECT t.id, coalesce(l.theme, 'Other') AS theme,
       coalesce(l.story_label, 'Uncategorized') AS story_label,
       CAST(coalesce(l.importance, 1) AS BIGINT) AS importance
FROM texts t LEFT JOIN labeled l USING (id)
""")
def label_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its label: stored, from a reply, or the default."""
    run = label_plan(a.texts(spark, sf_dir), label_cache(spark, sf_dir), label_reply_texts(spark, sf_dir))
    return run.labeled.select(
        "id", "theme", "story_label", F.col("importance").cast("bigint").alias("importance")
    )


_NEXT_CACHE = f"""
WITH {_CACHE}, {_ANSWERS},
changes AS (
  SELECT t.id AS article_id, t.url, t.title, t.description,
         sha256(t.title || chr(10) || t.description) AS content_hash, s.theme, s.story_label,
         s.importance, '{LABEL_MODEL}' AS model, '{LABEL_VERSION}' AS version
  FROM texts t JOIN answers s USING (id) WHERE t.id NOT IN (SELECT id FROM hits)
),
next AS (
  SELECT * FROM cache WHERE article_id NOT IN (SELECT article_id FROM changes)
  UNION ALL SELECT * FROM changes
)
SELECT article_id, content_hash, theme, story_label, CAST(importance AS BIGINT) AS importance,
       model, version FROM next
"""


@query(_NEXT_CACHE)
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label cache after a run; a new label replaces whatever the article had."""
    cache = label_cache(spark, sf_dir)
    run = label_plan(a.texts(spark, sf_dir), cache, label_reply_texts(spark, sf_dir))
    return _cache_rows(upsert(cache, run.new_cache_rows, ["article_id"]))


def _cache_rows(cache: DataFrame) -> DataFrame:
    return cache.select(
        "article_id", "content_hash", "theme", "story_label",
        F.col("importance").cast("bigint").alias("importance"), "model", "version",
    )


@query(_NEXT_CACHE)
def keyed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same label cache in a state folder: a base, and three runs that left changes.

    Of the new labels a third comes as something else first, and a third is gone for a run.
    """
    store = StateStore(spark, f"{run_folder(spark)}/state-{uuid.uuid4().hex}", change_share=float("inf"))
    cache = label_cache(spark, sf_dir)
    new = cut(label_plan(a.texts(spark, sf_dir), cache, label_reply_texts(spark, sf_dir)).new_cache_rows)
    third = F.pmod(F.xxhash64("article_id"), F.lit(3))
    store.replace_keys("article_labels", cache)
    first = new.where(third < 2).withColumn("theme", F.when(third == 0, F.lit("Other")).otherwise(F.col("theme")))
    store.replace_keys("article_labels", first, stale=new.where(third == 2))
    store.replace_keys("article_labels", new.where(third == 0))
    store.replace_keys("article_labels", new.where(third == 2))
    return _cache_rows(store.read("article_labels"))


@query(f"""
WITH {a.ART},
batches AS (
  SELECT id, CAST(floor((row_number() OVER (ORDER BY ordinal) - 1) / 200) AS BIGINT) AS batch,
         title, description FROM art
)
SELECT batch, count(*) AS items,
       sha256('[' || string_agg('{{"id":"' || id || '","title":"' || title || '","description":"'
              || description || '"}}', ',' ORDER BY id) || ']') AS request_hash
FROM batches GROUP BY batch
""")
def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles to be labeled as JSON batches of 200 in arrival order."""
    rows = build_requests(a.articles(spark, sf_dir))
    return rows.select("batch", "items", F.sha2("request", 256).alias("request_hash"))


def _sql_words(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_NAMES = f"""
names AS (
  SELECT p_partkey, p_brand, p_name, split_part(p_name, ' ', 1) AS word,
         split_part(p_name, ' ', 2) AS noun,
         split_part(p_name, ' ', 2) IN {_sql_words(PART_EVENTS)} AS generic
  FROM part
)"""


@query(f"""
WITH {_NAMES}
SELECT l.p_partkey, l.p_name AS left_label, r.p_name AS right_label,
       CAST(l.generic AS INTEGER) AS left_generic, l.word || CASE WHEN l.generic THEN '' ELSE ' ' || l.noun END AS words,
       CAST(l.p_name = r.p_name OR NOT (l.generic AND r.generic) OR l.word = r.word AS INTEGER) AS may_merge
FROM names l JOIN names r ON r.p_partkey = l.p_partkey + 1
""")
def label_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the names of neighbouring parts may be one story."""
    parts = a.table(spark, sf_dir, "part")
    left = parts.select("p_partkey", F.col("p_name").alias("left_label"))
    right = parts.select(
        (F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("right_label")
    )
    lists = {"generic": PART_EVENTS}
    return left.join(right, "p_partkey").select(
        "p_partkey",
        "left_label",
        "right_label",
        is_generic_label("left_label", **lists).cast("int").alias("left_generic"),
        F.array_join(distinctive_tokens("left_label", **lists), " ").alias("words"),
        may_be_same_story("left_label", "right_label", **lists).cast("int").alias("may_merge"),
    )


def _brand_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names of each brand in order of first use, as one proposed group each."""
    return (
        a.table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("group_pos"), F.col("p_name").alias("label"))
        .agg(F.min("p_partkey").alias("label_pos"))
    )


# First-fit in SQL: labels are placed one after the other into the clusters so far.
_FIRST_FIT = f"""{_NAMES},
members AS (
  SELECT p_brand AS group_pos, p_name AS label, word, generic, min(p_partkey) AS label_pos
  FROM names GROUP BY ALL
),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY group_pos ORDER BY label_pos) AS turn FROM members
),
placed AS (
  SELECT group_pos, turn, [{{'c': 0, 'g': generic, 'w': word, 'l': label}}] AS taken FROM turns WHERE turn = 1
  UNION ALL
  SELECT t.group_pos, t.turn, list_append(p.taken, {{'c':
           coalesce(list_min(list_filter(range(0, 1 + list_max(list_transform(p.taken, lambda m: m.c))),
             lambda c: len(list_filter(p.taken, lambda m: m.c = c AND m.g AND t.generic
                                       AND m.w <> t.word)) = 0)),
             1 + list_max(list_transform(p.taken, lambda m: m.c))),
         'g': t.generic, 'w': t.word, 'l': t.label}})
  FROM placed p JOIN turns t ON t.group_pos = p.group_pos AND t.turn = p.turn + 1
),
clusters AS (
  SELECT group_pos, m.l AS label, CAST(m.c AS BIGINT) AS cluster
  FROM (SELECT group_pos, unnest(arg_max(taken, turn)) AS m FROM placed GROUP BY group_pos)
)"""


@query(f"""
WITH RECURSIVE {_FIRST_FIT}
SELECT group_pos, label, cluster FROM clusters
""")
def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit clusters of the part names of each brand."""
    rows = cluster_labels(_brand_members(spark, sf_dir), generic=PART_EVENTS)
    return rows.select("group_pos", "label", "cluster")


@query(f"""
WITH RECURSIVE {_FIRST_FIT},
counts AS (
  SELECT group_pos, cluster, count(*) AS n, bool_or(c.label = 'hot ring') AS is_member,
         bool_and(NOT m.generic OR m.word = 'hot') AS fits, arg_min(c.label, m.label_pos) AS first_label
  FROM clusters c JOIN members m USING (group_pos, label) GROUP BY group_pos, cluster
),
named AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY group_pos) = 1 OR is_member OR fits
                 THEN 'hot ring' ELSE first_label END AS cluster_label
  FROM counts
)
SELECT c.label AS story_label, n.cluster_label AS group_label, count(*) AS placements
FROM clusters c JOIN named n USING (group_pos, cluster)
GROUP BY ALL
""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names merged as proposed per brand, all under one proposed name."""
    parts = a.table(spark, sf_dir, "part")
    labels = parts.groupBy(F.col("p_name").alias("story_label")).agg(
        F.min("p_partkey").alias("first_ordinal")
    )
    # A brand proposes its names in order of first use; names are few per brand.
    ordered = F.sort_array(F.collect_list(F.struct("label_pos", "label")))
    proposals = _brand_members(spark, sf_dir).groupBy("group_pos").agg(
        F.transform(ordered, lambda r: r["label"]).alias("labels")
    )
    number = F.regexp_extract("group_pos", r"(\d+)", 1).cast("bigint")
    proposals = proposals.select(
        number.alias("group_pos"), F.lit("hot ring").alias("canonical_label"), "labels"
    )
    merged = merge_labels(labels, proposals, generic=PART_EVENTS)
    return merged.groupBy("story_label", "group_label").agg(F.count("*").alias("placements"))
