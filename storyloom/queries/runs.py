"""Runs, state folders, requests and written files, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.constants import LABEL_MODEL, LABEL_VERSION
from storyloom.functions.text import content_hash
from storyloom.functions.urls import article_id, normalize_url
from storyloom.operators.coverage import daily_coverage
from storyloom.operators.coverage import recent_stories as find_recent
from storyloom.operators.ranking import number_rows
from storyloom.plans.daily import Replies, store_day
from storyloom.plans.digest import LINE_ORDER, digest_lines
from storyloom.plans.ingest import ingest
from storyloom.plans.tracking import label_requests
from storyloom.plans.tracking import match_requests as build_match_requests
from storyloom.queries import adapters as a
from storyloom.queries.registry import query
from storyloom.queries.reports import DIGEST_LINES
from storyloom.queries.reports import _STAMP as REPORT_STAMP
from storyloom.session import cut, run_folder
from storyloom.sources.sinks import write_daily_snapshot, write_lines
from storyloom.sources.state import StateStore

_DATE = "2024-01-20"
_PART = 40


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{run_folder(spark)}/{kind}-{uuid.uuid4().hex}"


_REBUILT = f"""{a.ART},
rebuilt AS (
  SELECT story_id, date, count(DISTINCT source) AS source_count, avg(importance) AS importance_avg FROM art
  WHERE date <> DATE '{_DATE}' OR source <> 'error' GROUP BY ALL
)"""


def _rebuilt_state(spark: SparkSession, sf_dir: str) -> StateStore:
    """Daily rows of all dates, of which one was written again from fewer articles."""
    store = StateStore(spark, _folder(spark, "state"))
    rows = a.articles(spark, sf_dir)
    names = rows.select("story_id", F.col("story_label").alias("canonical_label"), "theme")
    store.append("stories", names.groupBy("story_id").agg(F.first("canonical_label").alias("canonical_label")))
    store.replace_dates("story_daily", daily_coverage(rows, ["story_id", "date"]))
    fewer = rows.where((F.col("date") == F.lit(_DATE).cast("date")) & (F.col("source") != "error"))
    store.replace_date("story_daily", daily_coverage(fewer, ["story_id", "date"]), _DATE)
    return store


@query(f"""
WITH {_REBUILT}
SELECT story_id, CAST(date AS VARCHAR) AS date, source_count, round(importance_avg, 6) AS importance_avg
FROM rebuilt
""")
def state_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows read back from a state folder after one date was rebuilt."""
    rows = _rebuilt_state(spark, sf_dir).read("story_daily")
    return rows.select(
        "story_id", F.col("date").cast("string").alias("date"), "source_count",
        F.round("importance_avg", 6).alias("importance_avg"),
    )


@query(f"""
WITH {_REBUILT}
SELECT DISTINCT story_id, 'user ' || story_id AS canonical_label FROM rebuilt
WHERE date >= DATE '{_DATE}' - 3 AND date <= DATE '{_DATE}'
""")
def visible_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the four last days that still have a daily row after a rebuild."""
    store = _rebuilt_state(spark, sf_dir)
    days = store.read("story_daily", since="2024-01-17", before="2024-01-21")
    return store.read("stories").join(days, "story_id", "left_semi").select("story_id", "canonical_label")


_YESTERDAY = "1998-06-01"


@query(f"""
WITH {a.HIST}, {a.STORIES}
SELECT canonical_label, max(story_id) AS story_id
FROM stories JOIN (SELECT DISTINCT story_id FROM hist WHERE date = DATE '{_YESTERDAY}' - 1) USING (story_id)
GROUP BY canonical_label
""")
def yesterday_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the day before, one per label."""
    daily = a.history_articles(spark, sf_dir).select("story_id", "date")
    today = F.lit(_YESTERDAY).cast("date")
    rows = find_recent(a.history_stories(spark, sf_dir), daily, today, lookback_days=1)
    return rows.select("canonical_label", "story_id")


def _sql_requests(relation: str, label: str, order: str) -> str:
    return f"""
SELECT part, '["' || string_agg({label}, '","' ORDER BY n) || '"]' AS request
FROM (SELECT {label}, n, CAST(floor((n - 1) / {_PART}) AS BIGINT) AS part
      FROM (SELECT {label}, row_number() OVER (ORDER BY {order}) AS n FROM {relation}))
GROUP BY part"""


_LABELS = f"""{a.ART},
labels AS (SELECT story_label, min(ordinal) AS first_ordinal FROM art WHERE date = DATE '{_DATE}' GROUP BY ALL)"""


def _labels_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.articles(spark, sf_dir).where(F.col("date") == F.lit(_DATE).cast("date"))
    return rows.groupBy("story_label").agg(F.min("ordinal").alias("first_ordinal"))


@query(f"WITH {_LABELS} {_sql_requests('labels', 'story_label', 'first_ordinal')}")
def group_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a day as parts of a grouping request, in order of appearance."""
    rows = label_requests(_labels_of_day(spark, sf_dir), _PART)
    return rows.select(F.col("part").cast("bigint").alias("part"), "request")


@query(f"""
WITH {_LABELS}, {a.HIST}, {a.STORIES},
recent AS (
  SELECT DISTINCT canonical_label FROM stories
  JOIN (SELECT DISTINCT story_id FROM hist
        WHERE date >= DATE '{_YESTERDAY}' - 14 AND date < DATE '{_YESTERDAY}') USING (story_id)
)
SELECT 'today' AS kind, * FROM ({_sql_requests('labels', 'story_label', 'first_ordinal')})
UNION ALL
SELECT 'recent', * FROM ({_sql_requests('recent', 'canonical_label', 'canonical_label')})
""")
def match_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a day and those of recent stories, as parts of a matching request."""
    daily = a.history_articles(spark, sf_dir).select("story_id", "date")
    recent = find_recent(a.history_stories(spark, sf_dir), daily, F.lit(_YESTERDAY).cast("date"))
    rows = build_match_requests(_labels_of_day(spark, sf_dir), recent, _PART)
    return rows.select("kind", F.col("part").cast("bigint").alias("part"), "request")


_INGESTED = f"""{a.ART},
kept AS (
  SELECT *, substring(sha256(url), 1, 16) AS article_id FROM art
  WHERE CAST(reported_ts AS DATE) = DATE '{_DATE}'
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1
)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as feed items, in arrival order."""
    return a.articles(spark, sf_dir).select(
        "source", "language", F.col("ordinal").alias("item_pos"), "ordinal", "title", "url",
        "description", "published_at",
    )


@query(f"WITH {_INGESTED} SELECT article_id AS id, source, title, url, ordinal FROM kept")
def ingest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one day, one per address."""
    return ingest(_items(spark, sf_dir), _DATE).articles.select("id", "source", "title", "url", "ordinal")


@query(f"""
WITH {_INGESTED}
SELECT article_id AS id, source, title, '{_DATE}' AS date FROM kept
""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's articles written as a JSON snapshot (twice) and read back."""
    path = _folder(spark, "snapshot")
    articles = cut(ingest(_items(spark, sf_dir), _DATE).articles)
    write_daily_snapshot(articles.limit(3), path, _DATE)
    write_daily_snapshot(articles, path, _DATE)
    rows = spark.read.schema("id string, source string, title string, date string").json(path)
    return rows.select("id", "source", "title", F.col("date").cast("string").alias("date"))


@query(f"""
WITH {_INGESTED},
grouped AS (
  SELECT story_label, count(DISTINCT source) AS source_count, count(*) AS article_count,
         avg(importance) AS importance_avg, min(ordinal) AS first_ordinal, arg_min(theme, ordinal) AS theme
  FROM kept GROUP BY story_label
)
SELECT row_number() OVER (ORDER BY first_ordinal) AS story_id, story_label AS canonical_label, theme,
       source_count, article_count, round(importance_avg, 6) AS importance_avg
FROM grouped
""")
def stored_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run from items to state, with stored labels: stories and observations read back."""
    store = StateStore(spark, _folder(spark, "state"))
    # Items without a link share an address; of the day's, the first is the one that stays.
    kept = ingest(_items(spark, sf_dir), _DATE).articles.select("ordinal")
    rows = a.articles(spark, sf_dir).join(kept, "ordinal", "left_semi")
    labels = rows.select(
        article_id(normalize_url("url")).alias("article_id"), "url", "title", "description",
        content_hash("title", "description").alias("content_hash"), "theme", "story_label", "importance",
        F.lit(LABEL_MODEL).alias("model"), F.lit(LABEL_VERSION).alias("version"),
    )
    store.replace_keys("article_labels", labels)
    store_day(_items(spark, sf_dir), store, Replies.read(spark, None), _DATE)
    observed = store.read("story_observations", since=_DATE)
    return store.read("stories").join(observed, "story_id").select(
        "story_id", "canonical_label", "theme", "source_count", "article_count",
        F.round("importance_avg", 6).alias("importance_avg"),
    )


@query(f"""
WITH {DIGEST_LINES}
SELECT row_number() OVER (ORDER BY theme_rank, minus_importance, first_ordinal, block, undated, age, item_order)
       AS position, line
FROM every
""")
def digest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest written as text files and read back line by line in their order."""
    path = _folder(spark, "digest")
    lines = digest_lines(a.tracked(spark, sf_dir), REPORT_STAMP)
    write_lines(lines, path, [F.col(c) for c in LINE_ORDER])
    written = spark.read.text(path).select(
        F.col("value").alias("line"), F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("at"),
    )
    numbered = number_rows(written, [F.col("file"), F.col("at")])
    return numbered.select(F.col("position").cast("bigint").alias("position"), "line")
