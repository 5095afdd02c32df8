"""Coverage, look-backs and story bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import coverage as ops
from storyloom.operators.story_days import days_from_tables
from storyloom.queries import adapters as a
from storyloom.queries.registry import query


def _day(name: str = "date"):
    return F.col(name).cast("string").alias(name)


@query(f"""
WITH {a.ART}, {a.ART_DAILY}
SELECT story_id, CAST(date AS VARCHAR) AS date, source_count, article_count,
       round(importance_avg, 6) AS importance_avg, previous_count, trend
FROM art_daily
""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily coverage per story and its trend against the story's previous day."""
    days = a.article_days(a.articles(spark, sf_dir))
    return days.select(
        "story_id", _day(), "source_count", "article_count",
        F.round("importance_avg", 6).alias("importance_avg"), "previous_count", "trend",
    )


@query(f"""
WITH {a.HIST}, {a.STORIES},
days AS (SELECT DISTINCT story_id, date FROM hist),
seen AS (
  SELECT d.story_id, s.canonical_label, CAST(d.date + n.i AS DATE) AS today, max(d.date) AS last_daily
  FROM days d JOIN stories s USING (story_id), (SELECT unnest(range(1, 15))::INTEGER AS i) n
  GROUP BY ALL
)
SELECT CAST(today AS VARCHAR) AS today, canonical_label, story_id,
       CAST(last_daily AS VARCHAR) AS last_daily
FROM seen
QUALIFY row_number() OVER (PARTITION BY today, canonical_label
                           ORDER BY last_daily DESC, story_id DESC) = 1
""")
def recent_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the 14 days before every run date, newest one per label."""
    rows = ops.recent_stories_history(
        a.history_stories(spark, sf_dir), a.history_articles(spark, sf_dir)
    )
    return rows.select(_day("today"), "canonical_label", "story_id", _day("last_daily"))


@query(f"""
WITH {a.HIST}, {a.OBSERVATIONS},
told AS (
  SELECT *, CASE WHEN trim(coalesce(summary, ''), ' ' || chr(10)) <> ''
                   OR trim(coalesce(delta_summary, ''), ' ' || chr(10)) <> '' THEN date END AS told_on
  FROM observations
),
pick AS (
  SELECT story_id, date, max(told_on) OVER (PARTITION BY story_id ORDER BY date
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_observed
  FROM told
)
SELECT p.story_id, CAST(p.date AS VARCHAR) AS date, CAST(p.last_observed AS VARCHAR) AS last_observed,
       nullif(trim(o.summary, ' ' || chr(10)), '') AS summary,
       nullif(trim(o.delta_summary, ' ' || chr(10)), '') AS delta_summary
FROM pick p LEFT JOIN observations o ON o.story_id = p.story_id AND o.date = p.last_observed
""")
def prior_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every story day the latest earlier observation that holds any text."""
    rows = ops.prior_observation_history(a.history_observations(spark, sf_dir))
    return rows.select(
        "story_id", _day(), F.col("memory.last_observed").cast("string").alias("last_observed"),
        "memory.summary", "memory.delta_summary",
    )


@query(f"""
WITH {a.HIST},
numbered AS (
  SELECT *, row_number() OVER w AS n,
         count(*) OVER (PARTITION BY story_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
                        AND INTERVAL 1 DAY PRECEDING) AS earlier
  FROM hist WINDOW w AS (PARTITION BY story_id ORDER BY date, reported_at, id DESC)
),
days AS (SELECT DISTINCT story_id, date, earlier FROM numbered)
SELECT d.story_id, CAST(d.date AS VARCHAR) AS date,
       coalesce(string_agg(CAST(n.date AS VARCHAR) || ' ' || n.reported_at || ' ' || n.title, '; '
                           ORDER BY n.n DESC), '') AS recent
FROM days d LEFT JOIN numbered n
  ON n.story_id = d.story_id AND n.n <= d.earlier AND n.n > d.earlier - 3
GROUP BY d.story_id, d.date
""")
def last3_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every story day the three latest earlier articles, newest first."""
    rows = ops.prior_articles_history(a.history_articles(spark, sf_dir))
    shown = F.transform(
        "recent_articles",
        lambda r: F.concat_ws(" ", r["date"].cast("string"), r["reported_at"], r["title"]),
    )
    return rows.select("story_id", _day(), F.array_join(shown, "; ").alias("recent"))


@query(f"""
WITH {a.HIST}
SELECT story_id, CAST(min(date) AS VARCHAR) AS first_seen, CAST(max(date) AS VARCHAR) AS last_seen
FROM hist GROUP BY story_id
""")
def story_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of every story."""
    rows = ops.story_bounds(a.history_articles(spark, sf_dir))
    return rows.select("story_id", _day("first_seen"), _day("last_seen"))


@query(f"""
WITH {a.HIST}, {a.OBSERVATIONS}, {a.STORIES},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY date, reported_at, id DESC) AS n,
         count(*) OVER (PARTITION BY story_id ORDER BY date) AS so_far
  FROM hist
),
told AS (
  SELECT story_id, date, CASE WHEN trim(coalesce(summary, ''), ' ' || chr(10)) <> ''
              OR trim(coalesce(delta_summary, ''), ' ' || chr(10)) <> '' THEN date END AS told_on
  FROM observations
),
days AS (
  SELECT story_id, date, so_far, count(DISTINCT source) AS source_count FROM numbered GROUP BY ALL
),
carried AS (
  SELECT d.*, lag(d.date) OVER w AS previous_date, min(d.date) OVER w AS first_seen,
         max(t.told_on) OVER w AS last_observed
  FROM days d LEFT JOIN told t USING (story_id, date) WINDOW w AS (PARTITION BY d.story_id ORDER BY d.date)
)
SELECT c.story_id, CAST(c.date AS VARCHAR) AS date, s.canonical_label, c.source_count,
       CAST(c.previous_date AS VARCHAR) AS previous_date, CAST(c.first_seen AS VARCHAR) AS first_seen,
       CAST(c.last_observed AS VARCHAR) AS last_observed,
       (SELECT nullif(trim(o.summary, ' ' || chr(10)), '') FROM observations o
        WHERE o.story_id = c.story_id AND o.date = c.last_observed) AS summary,
       string_agg(n.title, '; ' ORDER BY n.n DESC) AS recent
FROM carried c JOIN stories s USING (story_id)
JOIN numbered n ON n.story_id = c.story_id AND n.n <= c.so_far AND n.n > c.so_far - 3
GROUP BY ALL
""")
def story_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known after every story day: last count, memory, latest articles and bounds."""
    articles = a.history_articles(spark, sf_dir)
    rows = days_from_tables(
        a.history_stories(spark, sf_dir),
        ops.daily_coverage(articles, ["story_id", "date"]),
        a.history_observations(spark, sf_dir),
        articles.withColumnRenamed("reported_at", "published_at"),
    )
    return rows.select(
        "story_id", _day(), "canonical_label", "source_count", _day("previous_date"), _day("first_seen"),
        F.col("memory.last_observed").cast("string").alias("last_observed"), "memory.summary",
        F.array_join(F.transform("recent_articles", lambda r: r["title"]), "; ").alias("recent"),
    )
