"""Claims and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.constants import CLAIM_VERSION
from storyloom.functions.render import evidence_line
from storyloom.functions.stories import choose
from storyloom.functions.text import claim_input, claim_input_hash
from storyloom.plans.claims import (
    attribute_claims,
    best_claims,
    claim_inputs,
    GroundedClaims,
    ground_claims,
    judge_claims,
    next_claims,
)
from storyloom.plans.claims import story_claims as describe_claims
from storyloom.plans.briefing import evidence_lines
from storyloom.queries import adapters as a
from storyloom.queries.registry import query


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.texts(spark, sf_dir).withColumn("story_id", F.col("ordinal") % 50)


def _json_text(name: str, value: Column) -> Column:
    """``"name":"value"`` with the value escaped."""
    whole = F.to_json(F.struct(value.alias(name)))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def claim_reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per document: a sound claim, a faulty one and one from ``benchmark``.

    Documents with an id divisible by 20 get no usable reply.
    """
    docs = a.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = a.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("passage")
    )
    doc = F.col("doc_id")
    kind = doc % 8

    def claim(kind_of_claim: Column, entities: Column, span: Column, confidence: Column) -> Column:
        return F.concat(
            F.lit('{"claim_text":" claim ","claim_type":"'), kind_of_claim, F.lit('","entities":'),
            entities, F.lit(","), _json_text("evidence_span", span), F.lit(',"confidence":'),
            confidence, F.lit("}"),
        )

    # From the start, the middle or the end of a text.
    start = 5 + (doc % 3) * F.floor(F.greatest(F.length("text") - 64, F.lit(0)) / 2)
    quoted = F.substring("text", start.cast("int"), F.lit(60))
    quoted = F.lower(F.replace(quoted, F.lit(" "), F.lit(" \n ")))
    sound = claim(F.lit("fact"), F.lit('["x"," y "]'), quoted, F.lit("0.9"))
    faulty = claim(
        F.when(kind == 0, F.lit("rumor")).otherwise(F.lit("quote")),
        F.when(kind == 4, F.lit('"x"')).when(kind == 5, F.lit('["x",1]')).otherwise(F.lit("[]")),
        F.when(kind == 1, F.lit(" ")).when(kind == 2, F.lit("Zz never said")).otherwise(quoted),
        choose(kind, {3: '"high"', 6: "true", 7: "1.5"}, "1"),
    )
    passage = claim(F.lit("background"), F.lit("[]"), F.col("passage"), F.lit("0"))
    claims = F.concat_ws(",", sound, faulty, F.when(F.col("passage").isNotNull(), passage))
    return docs.join(items, "doc_id", "left").select(
        doc.alias("reply_no"),
        doc.cast("string").alias("article_id"),
        F.when(doc % 20 == 0, F.concat(F.lit('{"claims":{"a":'), claims, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"claims":['), claims, F.lit("]}")))
        .alias("reply"),
    )


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _fold(text: str) -> str:
    return rf"lower(trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g')))"


def _trim(text: str) -> str:
    return rf"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_CONTENT = f"""{a.TEXTS},
inputs AS (
  SELECT id AS article_id, ordinal, ordinal % 50 AS story_id, {_trim(
      f"{_trim('title')} || chr(10) || chr(10) || "
      + _trim("regexp_replace(description, '<[^>]+>', ' ', 'g')")
  )} AS content
  FROM texts
),
proposed AS (
  SELECT doc_id, 0 AS pos, lower(replace(substring(text, CAST(5 + (doc_id % 3) * (greatest(length(text) - 64, 0) // 2) AS BIGINT), 60), ' ', ' ' || chr(10) || ' ')) AS span,
         NULL AS fault, 0.9 AS confidence, 'x|y' AS entities, 'fact' AS claim_type
  FROM documents
  UNION ALL
  SELECT doc_id, 1, CASE doc_id % 8 WHEN 1 THEN '' WHEN 2 THEN 'Zz never said'
                    ELSE lower(replace(substring(text, CAST(5 + (doc_id % 3) * (greatest(length(text) - 64, 0) // 2) AS BIGINT), 60), ' ', ' ' || chr(10) || ' ')) END,
         CASE doc_id % 8 WHEN 0 THEN 'unknown_type' WHEN 4 THEN 'bad_entities'
                         WHEN 5 THEN 'bad_entities' WHEN 3 THEN 'bad_confidence'
                         WHEN 6 THEN 'bad_confidence' WHEN 7 THEN 'bad_confidence' END,
         1.0, '', 'quote'
  FROM documents
  UNION ALL
  SELECT d.doc_id, 2, b.text, NULL, 0.0, '', 'background'
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id
),
judged AS (
  SELECT p.*, i.article_id, i.story_id, i.content,
         CASE WHEN fault IN ('unknown_type', 'bad_entities') THEN fault
              WHEN {_trim('span')} = '' THEN 'empty_evidence'
              WHEN NOT contains({_fold('content')}, {_fold('span')}) THEN 'ungrounded_evidence'
              ELSE coalesce(fault, 'kept') END AS verdict
  FROM proposed p JOIN inputs i ON i.ordinal = p.doc_id
  WHERE p.doc_id % 20 <> 0 AND i.content <> ''
)"""


@query(f"""
WITH {_CONTENT}
SELECT article_id, CAST(pos AS BIGINT) AS pos, story_id, verdict, claim_type,
       CAST(CASE WHEN verdict = 'kept' THEN confidence END AS DOUBLE) AS confidence,
       CASE WHEN verdict = 'kept' THEN entities END AS entities,
       sha256({_trim('span')}) AS span_hash
FROM judged
""")
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposed claim with the rule it breaks, or kept."""
    judged = judge_claims(
        claim_inputs(_inputs(spark, sf_dir)), claim_reply_texts(spark, sf_dir)
    )
    kept = F.col("reject_reason").isNull()
    return judged.select(
        "article_id",
        (F.col("claim_pos") % (1 << 32)).alias("pos"),
        "story_id",
        F.coalesce("reject_reason", F.lit("kept")).alias("verdict"),
        F.when(F.col("claim_type") == "rumor", F.lit("quote")).otherwise(F.col("claim_type")).alias(
            "claim_type"
        ),
        F.when(kept, F.col("confidence")).alias("confidence"),
        F.when(kept, F.array_join("entities", "|")).alias("entities"),
        F.sha2("evidence_span", 256).alias("span_hash"),
    )


def _stored_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier claim runs for the documents in ``labels``; some for another text or story."""
    marks = a.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("id"), "doc_id"
    )
    doc = F.col("doc_id")
    return (
        a.texts(spark, sf_dir)
        .join(marks, "id")
        .withColumn("content", claim_input("title", "description"))
        .select(
            F.col("id").alias("article_id"),
            F.lit(CLAIM_VERSION).alias("version"),
            (doc % 50 + F.when(doc % 3 == 0, 1).otherwise(0)).alias("story_id"),
            F.when(doc % 4 == 0, F.lit("older")).otherwise(claim_input_hash("content")).alias("content_hash"),
            F.lit(1).cast("bigint").alias("claims_count"),
        )
    )


def _stored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = F.explode(F.array(F.lit(CLAIM_VERSION), F.lit("older-version")))
    return _stored_extractions(spark, sf_dir).select(
        "article_id", "story_id", versions.alias("version")
    ).select(
        F.concat_ws(":", "article_id", F.lit("stored"), "version").alias("claim_id"),
        "article_id",
        "story_id",
        F.lit("stored claim").alias("claim_text"),
        F.lit("fact").alias("claim_type"),
        F.array().cast("array<string>").alias("entities"),
        F.lit("stored").alias("evidence_span"),
        F.lit(0.5).alias("confidence"),
        "version",
    )


@query(f"""
WITH {_CONTENT},
stored AS (
  SELECT i.article_id, l.doc_id, l.doc_id % 50 + CASE WHEN l.doc_id % 3 = 0 THEN 1 ELSE 0 END AS story_id,
         l.doc_id % 4 = 0 OR i.content = '' AS outdated, i.story_id AS today_story
  FROM labels l JOIN inputs i ON i.ordinal = l.doc_id
),
hits AS (SELECT * FROM stored WHERE NOT outdated)
SELECT article_id, story_id, '{CLAIM_VERSION}' AS version, verdict FROM (
  SELECT article_id, today_story AS story_id, 'stored' AS verdict FROM hits
  UNION ALL
  SELECT article_id, story_id, 'new' FROM judged
  WHERE verdict = 'kept' AND article_id NOT IN (SELECT article_id FROM hits)
  UNION ALL
  SELECT s.article_id, s.story_id, 'stored' FROM stored s JOIN inputs i USING (article_id)
  WHERE i.content = ''
)
UNION ALL
SELECT article_id, story_id, 'older-version', 'stored' FROM stored
""")
def claim_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a run: cached ones follow their story, outdated ones are replaced."""
    claims = _stored_claims(spark, sf_dir)
    run = ground_claims(
        _inputs(spark, sf_dir),
        claims,
        _stored_extractions(spark, sf_dir),
        claim_reply_texts(spark, sf_dir),
    )
    stored = F.col("evidence_span") == "stored"
    return next_claims(claims, run).select(
        "article_id",
        "story_id",
        "version",
        F.when(stored, F.lit("stored")).otherwise(F.lit("new")).alias("verdict"),
    )


@query(f"""
WITH {_CONTENT},
hits AS (SELECT i.article_id FROM labels l JOIN inputs i ON i.ordinal = l.doc_id
         WHERE l.doc_id % 4 <> 0 AND i.content <> '')
SELECT 'cached' AS counter, count(*) AS articles FROM hits
UNION ALL
SELECT 'extracted', count(*) FROM inputs
WHERE ordinal % 20 <> 0 AND content <> '' AND article_id NOT IN (SELECT article_id FROM hits)
UNION ALL
SELECT 'failed', count(*) FROM inputs
WHERE ordinal % 20 = 0 AND content <> '' AND article_id NOT IN (SELECT article_id FROM hits)
UNION ALL
SELECT 'invalid', count(*) FROM judged
WHERE verdict <> 'kept' AND article_id NOT IN (SELECT article_id FROM hits)
""")
def claim_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles extracted, cached and failed in a claim run, and claims rejected."""
    return _claim_run(spark, sf_dir).counters().withColumnRenamed("count", "articles")


def _claim_run(spark: SparkSession, sf_dir: str) -> GroundedClaims:
    return ground_claims(
        _inputs(spark, sf_dir),
        _stored_claims(spark, sf_dir),
        _stored_extractions(spark, sf_dir),
        claim_reply_texts(spark, sf_dir),
    )


@query(f"""
WITH {_CONTENT},
hits AS (SELECT i.article_id FROM labels l JOIN inputs i ON i.ordinal = l.doc_id
         WHERE l.doc_id % 4 <> 0 AND i.content <> '')
SELECT article_id, (SELECT count(*) FROM judged j WHERE j.article_id = i.article_id AND verdict = 'kept') AS claims_count
FROM inputs i
WHERE ordinal % 20 <> 0 AND content <> '' AND article_id NOT IN (SELECT article_id FROM hits)
""")
def saved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims saved for each article that was answered, none included."""
    return _claim_run(spark, sf_dir).extractions.select("article_id", "claims_count")


def _label_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the labeled documents: two stored texts per document, some without source."""
    doc = F.col("doc_id")
    return a.table(spark, sf_dir, "labels").select(
        F.lpad(doc.cast("string"), 12, "0").alias("claim_id"),
        doc.cast("string").alias("article_id"),
        (doc % 20).alias("story_id"),
        F.lit(CLAIM_VERSION).alias("version"),
        F.when(F.col("toxic") == 1, F.lit("allegation")).otherwise(F.lit("fact")).alias("claim_type"),
        F.concat(F.lit("span "), doc.cast("string")).alias("evidence_span"),
        ((F.col("quality") * 3 + F.col("toxic")) / 10).alias("confidence"),
    )


_LABEL_CLAIMS = """
claims AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS claim_id, CAST(doc_id AS VARCHAR) AS article_id,
         doc_id % 20 AS story_id, CASE WHEN toxic = 1 THEN 'allegation' ELSE 'fact' END AS claim_type,
         'span ' || doc_id AS evidence_span, (quality * 3 + toxic) / 10 AS confidence
  FROM labels
)"""


@query(f"""
WITH {_LABEL_CLAIMS}
SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY confidence DESC, claim_id) AS rank,
       claim_id, confidence
FROM claims QUALIFY rank <= 12
""")
def claim_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve surest claims of every story."""
    rows = best_claims(_label_claims(spark, sf_dir), 12)
    return rows.select("story_id", F.col("rank").cast("bigint").alias("rank"), "claim_id", "confidence")


def _stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as articles on two days; some under another story or without a source."""
    doc = F.col("ordinal")
    source = F.when(doc % 6 == 0, F.lit("")).otherwise(F.col("source"))
    return a.texts(spark, sf_dir).withColumn("day", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "id",
        (doc % F.when(doc % 5 == 0, F.lit(19)).otherwise(F.lit(20))).alias("story_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("date"),
        F.concat(source, F.when(source == "", F.lit("")).otherwise(F.col("day").cast("string"))).alias("source"),
        F.concat(F.lit("title "), F.col("id"), F.lit(" "), F.col("day").cast("string")).alias("title"),
        "url",
    )


_DESCRIBED = f"""{_LABEL_CLAIMS}, {a.TEXTS},
described AS (
  SELECT c.*, CASE WHEN t.ordinal % 6 = 0 THEN '' ELSE t.source || '2' END AS source,
         'title ' || t.id || ' 2' AS article_title, t.url, t2.source AS today_source,
         'today ' || t2.id AS today_title, t2.url AS today_url, t.id IS NULL AS missing
  FROM claims c
  LEFT JOIN texts t ON t.id = c.article_id AND c.story_id =
       t.ordinal % CASE WHEN t.ordinal % 5 = 0 THEN 19 ELSE 20 END
  LEFT JOIN texts t2 ON t2.id = c.article_id
)"""


@query(f"""
WITH {_DESCRIBED}
SELECT claim_id, story_id, CASE WHEN missing THEN NULL ELSE source END AS source,
       CASE WHEN missing THEN NULL ELSE article_title END AS article_title, url,
       coalesce(CASE WHEN missing OR source = '' THEN NULL ELSE source END, today_source, '') AS shown_source,
       coalesce(CASE WHEN missing THEN NULL ELSE article_title END, today_title, '') AS shown_title
FROM described
""")
def story_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their stored article, and with blanks filled from today's article."""
    claims = describe_claims(_label_claims(spark, sf_dir), _stored_articles(spark, sf_dir))
    today = a.texts(spark, sf_dir).select(
        "id", (F.col("ordinal") % 20).alias("story_id"), "source",
        F.concat(F.lit("today "), F.col("id")).alias("title"), "url", "ordinal",
    )
    shown = attribute_claims(claims, today).select(
        "claim_id", F.col("source").alias("shown_source"), F.col("article_title").alias("shown_title")
    )
    return claims.select("claim_id", "story_id", "source", "article_title", "url").join(
        shown, "claim_id"
    )


_LINE = """'- `' || claim_type || '` — '
       || CASE WHEN missing THEN 'Unknown source'
               ELSE '[' || coalesce(nullif(source, ''), 'Unknown source') || '](' || url || ')' END
       || ' — "' || evidence_span || '" _('
       || CAST(trunc(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END * 100) AS INTEGER) || '%)_'"""


@query(f"""
WITH {_DESCRIBED}
SELECT claim_id, {_LINE} AS line FROM described
""")
def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence line of every claim."""
    claims = describe_claims(_label_claims(spark, sf_dir), _stored_articles(spark, sf_dir))
    line = evidence_line("claim_type", "source", "url", "evidence_span", "confidence")
    return claims.select("claim_id", line.alias("line"))


@query(f"""
WITH {_DESCRIBED},
best AS (
  SELECT *, {_LINE} AS line, row_number() OVER (PARTITION BY story_id ORDER BY confidence DESC, claim_id) AS n
  FROM described QUALIFY n <= 8
)
SELECT story_id, 210 AS block, n AS item_order, line FROM best
UNION ALL
SELECT story_id, unnest([200, 201]), 0, unnest(['', '### Evidence']) FROM (SELECT DISTINCT story_id FROM best)
""")
def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence part of a briefing: heading and the eight surest claims of every story."""
    claims = describe_claims(_label_claims(spark, sf_dir), _stored_articles(spark, sf_dir))
    shown = claims.select("story_id").distinct().select(
        "story_id", F.lit(0).alias("section_rank"), F.col("story_id").alias("rank")
    )
    return evidence_lines(claims, shown).select(
        F.col("rank").alias("story_id"), F.col("block").cast("int").alias("block"), "item_order", "line"
    )
