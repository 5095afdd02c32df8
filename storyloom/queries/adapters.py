"""Driver tables seen as the pipeline's tables, in Spark and in SQL.

events     -> articles of many days (story = user, source = event type)
orders     -> long story history (story = customer, source = priority)
documents  -> article texts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.constants import THEMES
from storyloom.functions.dates import parse_reported
from storyloom.functions.stories import choose
from storyloom.operators.coverage import coverage_trend_history, daily_coverage

# What events report, by their number k; gives the place finder real work.
PHRASES = [
    "talks in Tehran over the Strait of Hormuz",
    "Dutch cabinet split over budget",
    "London and Paris agree",
    "global markets fall",
    "U.S. Congress votes",
    "<b>Kyiv</b> and Moscow trade fire",
    "local council meets",
    "Mali and Chad border clash",
    "Europe weighs supply chain rules",
    "Kim Jong-un in Beijing",
    "museum opens; nothing else",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labeled articles."""
    event = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    mail_date = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    day = F.col("ts").cast("date")
    topic = F.when(k % 29 == 0, F.lit("celebrity video ")).otherwise(F.lit("report "))
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        event.alias("ordinal"),
        F.col("event_type").alias("source"),
        F.lit("en").alias("language"),
        F.col("user_id").alias("story_id"),
        day.alias("date"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" on "), day.cast("string")).alias(
            "canonical_label"
        ),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("story_label"),
        F.concat(topic, F.col("event_type"), F.lit(" "), k.cast("string")).alias("title"),
        _lookup(k % len(PHRASES), PHRASES).alias("description"),
        F.when(event % 23 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("https://news.example/"), F.col("event_type"), F.lit("/"), event.cast("string")))
        .alias("url"),
        F.when(event % 17 == 0, F.lit(""))
        .when(event % 19 == 0, F.lit("not a date"))
        .otherwise(mail_date)
        .alias("published_at"),
        (event % 5 + 1).cast("int").alias("importance"),
        _lookup(k % len(THEMES), THEMES).alias("theme"),
    )


ART = f"""
art AS (
  SELECT event_id AS id, event_id AS ordinal, event_type AS source, user_id AS story_id,
         CAST(ts AS DATE) AS date, k,
         'user ' || user_id || ' on ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS canonical_label,
         'user ' || user_id AS story_label,
         CASE WHEN k % 29 = 0 THEN 'celebrity video ' ELSE 'report ' END
           || event_type || ' ' || k AS title,
         ({_sql_list(PHRASES)})[1 + k % {len(PHRASES)}] AS description,
         CASE WHEN event_id % 23 = 0 THEN ''
              ELSE 'https://news.example/' || event_type || '/' || event_id END AS url,
         CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'not a date'
              ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') END AS published_at,
         CASE WHEN event_id % 17 <> 0 AND event_id % 19 <> 0
              THEN date_trunc('second', ts) END AS reported_ts,
         1 + event_id % 5 AS importance,
         ({_sql_list(THEMES)})[1 + k % {len(THEMES)}] AS theme
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""

ART_DAILY = """
art_daily AS (
  SELECT *, CASE WHEN previous_count IS NULL THEN 'new'
                 WHEN source_count - previous_count > 1 THEN 'up'
                 WHEN source_count - previous_count < -1 THEN 'down' ELSE 'steady' END AS trend
  FROM (SELECT story_id, date, count(DISTINCT source) AS source_count,
               count(*) AS article_count, avg(importance) AS importance_avg,
               lag(count(DISTINCT source)) OVER (PARTITION BY story_id ORDER BY date) AS previous_count,
               lag(date) OVER (PARTITION BY story_id ORDER BY date) AS previous_date
        FROM art GROUP BY story_id, date)
)"""


def article_days(rows: DataFrame) -> DataFrame:
    return coverage_trend_history(daily_coverage(rows, ["story_id", "date"], "story_id"))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracked articles: a story per user and day with trend and context."""
    rows = articles(spark, sf_dir)
    days = article_days(articles(spark, sf_dir))
    summary = F.concat(
        F.lit("Previously: coverage came from "), F.col("previous_count").cast("string"),
        F.lit(" sources. More is expected."),
    )
    context = F.when(
        F.col("previous_count").isNotNull(), F.struct(summary.alias("summary"))
    ).alias("previous_context")
    days = days.select("story_id", "date", "trend", context)
    observation = F.col("story_id") * 100_000 + F.datediff(
        "date", F.lit("1970-01-01").cast("date")
    )
    return (
        rows.join(days, ["story_id", "date"])
        .withColumn("observation_id", observation)
        .withColumn("reported_ts", parse_reported("published_at"))
    )


TRACKED = f"""{ART}, {ART_DAILY},
tracked AS (
  SELECT a.*, d.trend,
         a.story_id * 100000 + date_diff('day', DATE '1970-01-01', a.date) AS observation_id,
         CASE WHEN d.previous_count IS NOT NULL THEN 'Previously: coverage came from '
              || d.previous_count || ' sources. More is expected.' END AS context_summary
  FROM art a JOIN art_daily d USING (story_id, date)
)"""


def history_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored articles of many years."""
    order = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order.alias("id"),
        F.col("o_custkey").alias("story_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("source"),
        F.concat(F.lit("order "), order.cast("string")).alias("title"),
        F.col("o_orderstatus").alias("description"),
        F.concat(F.lit("https://orders.example/"), order.cast("string")).alias("url"),
        F.lpad((order % 1000).cast("string"), 4, "0").alias("reported_at"),
        (order % 5 + 1).cast("int").alias("importance"),
    )


HIST = """
hist AS (
  SELECT o_orderkey AS id, o_custkey AS story_id, CAST(o_orderdate AS DATE) AS date,
         o_orderpriority AS source, 'order ' || o_orderkey AS title,
         o_orderstatus AS description, 'https://orders.example/' || o_orderkey AS url,
         lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0') AS reported_at,
         1 + o_orderkey % 5 AS importance
  FROM orders
)"""


def history_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stories; several share a label."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("story_id"),
        F.concat(F.lit("segment "), (F.col("c_custkey") % 97).cast("string")).alias("canonical_label"),
    )


STORIES = """
stories AS (
  SELECT c_custkey AS story_id, 'segment ' || (c_custkey % 97) AS canonical_label FROM customer
)"""


def history_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per story and day, some of them blank."""
    last = history_articles(spark, sf_dir).groupBy("story_id", "date").agg(
        F.max_by("description", "id").alias("status"),
        F.max_by("source", "id").alias("priority"),
        F.max("id").alias("id"),
    )
    summary = choose("status", {"O": " \n ", "P": ""}, None)
    return last.select(
        "story_id",
        "date",
        F.when(
            F.col("status") == "F", F.concat(F.lit(" closed "), F.col("id").cast("string"))
        ).otherwise(summary).alias("summary"),
        F.when(F.startswith("priority", F.lit("1")), F.lit("urgent\n")).alias("delta_summary"),
    )


OBSERVATIONS = """
observations AS (
  SELECT story_id, date,
         CASE WHEN status = 'F' THEN ' closed ' || id WHEN status = 'O' THEN ' ' || chr(10) || ' '
              WHEN status = 'P' THEN '' END AS summary,
         CASE WHEN priority LIKE '1%' THEN 'urgent' || chr(10) END AS delta_summary
  FROM (SELECT story_id, date, arg_max(description, id) AS status,
               arg_max(source, id) AS priority, max(id) AS id
        FROM hist GROUP BY story_id, date)
)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first 80 characters are the title."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("ordinal"),
        "source",
        F.col("lang").alias("language"),
        F.substring("text", 1, 80).alias("title"),
        F.expr("substring(text, 81)").alias("description"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"),
    )


TEXTS = """
texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ordinal, source, lang AS language,
         substring(text, 1, 80) AS title, substring(text, 81) AS description,
         'https://docs.example/' || doc_id AS url
  FROM documents
)"""
