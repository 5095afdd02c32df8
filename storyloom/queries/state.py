"""State tables after a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import tables
from storyloom.operators.coverage import daily_coverage
from storyloom.queries import adapters as a
from storyloom.queries.registry import query
from storyloom.sources.replies import payload_replies

_DATE = "2024-01-20"


@query(f"""
WITH {a.ART},
daily AS (SELECT story_id, date, count(DISTINCT source) AS source_count, count(*) AS article_count
          FROM art GROUP BY ALL),
rebuilt AS (SELECT story_id, date, count(DISTINCT source) AS source_count, count(*) AS article_count
            FROM art WHERE date = DATE '{_DATE}' AND source <> 'error' GROUP BY ALL)
SELECT story_id, CAST(date AS VARCHAR) AS date, source_count, article_count
FROM (SELECT * FROM daily WHERE date <> DATE '{_DATE}' UNION ALL SELECT * FROM rebuilt)
""")
def date_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows after one date was rebuilt from other articles."""
    rows = a.articles(spark, sf_dir)
    day = F.lit(_DATE).cast("date")
    daily = daily_coverage(rows, ["story_id", "date"])
    rebuilt = daily_coverage(
        rows.filter((F.col("date") == day) & (F.col("source") != "error")), ["story_id", "date"]
    )
    return tables.rebuild_date(daily, rebuilt, day).select(
        "story_id", F.col("date").cast("string").alias("date"), "source_count", "article_count"
    )


@query(f"""
WITH {a.ART},
writes AS (
  SELECT story_id, date, theme, count(*) AS article_count, max(ordinal) AS group_order
  FROM art GROUP BY ALL
)
SELECT story_id, CAST(date AS VARCHAR) AS date, theme, article_count FROM writes
QUALIFY row_number() OVER (PARTITION BY story_id, date ORDER BY group_order DESC) = 1
""")
def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several groups on one story and day the one written last."""
    writes = a.articles(spark, sf_dir).groupBy("story_id", "date", "theme").agg(
        F.count("*").alias("article_count"), F.max("ordinal").alias("group_order")
    )
    rows = tables.last_write_per_key(writes, ["story_id", "date"], F.col("group_order"))
    return rows.select("story_id", F.col("date").cast("string").alias("date"), "theme", "article_count")


@query(f"""
WITH {a.HIST}, {a.OBSERVATIONS},
numbered AS (SELECT *, story_id * 100000 + date_diff('day', DATE '1970-01-01', date) AS observation_id
             FROM observations)
SELECT observation_id,
       CASE WHEN observation_id % 3 = 0 THEN 'note ' || observation_id
            WHEN observation_id % 3 = 1 AND observation_id % 2 = 0 THEN '' ELSE summary END AS summary,
       CASE WHEN observation_id % 3 = 0 THEN ''
            WHEN observation_id % 3 = 1 AND observation_id % 2 = 0 THEN 'turn' ELSE delta_summary END AS delta_summary
FROM numbered
""")
def memory_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations after the texts of a report were written back."""
    day_number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    observations = a.history_observations(spark, sf_dir).withColumn(
        "observation_id", F.col("story_id") * 100_000 + day_number
    )
    key = F.col("observation_id")
    memories = observations.select(
        "observation_id",
        F.when(key % 3 == 0, F.concat(F.lit(" note "), key.cast("string"))).alias("summary"),
        F.when((key % 3 == 1) & (key % 2 == 0), F.lit("turn\n")).alias("delta_summary"),
    )
    rows = tables.write_memory(observations, memories)
    return rows.select("observation_id", "summary", "delta_summary")


def _payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and second payloads per customer, as objects or bare text."""
    key = F.col("c_custkey")
    rows = a.table(spark, sf_dir, "customer").select(
        key, F.col("c_name").alias("canonical_label"), "c_mktsegment"
    )
    name = F.col("c_mktsegment")
    first = (
        F.when(key % 4 == 0, F.concat(F.lit('{"briefing":" '), name, F.lit(' ","delta":"d"}')))
        .when(key % 4 == 1, F.concat(F.lit('"'), name, F.lit('"')))
        .when(key % 4 == 2, F.lit('{"briefing":"","delta_summary":"e","delta":"d"}'))
    )
    retry = F.when(key % 2 == 0, F.lit('{"briefing":" ","delta_summary":"later"}')).when(
        key % 6 == 3, F.lit('"again"')
    )
    label = "canonical_label"
    return (
        payload_replies(rows.select(label, first.alias("payload")).filter("payload is not null")),
        payload_replies(rows.select(label, retry.alias("payload")).filter("payload is not null")),
    )


_MERGED = """
merged AS (
  SELECT c_name AS canonical_label,
         CASE WHEN c_custkey % 6 = 3 THEN 'again' WHEN c_custkey % 4 IN (0, 1) THEN c_mktsegment
              ELSE '' END AS briefing,
         CASE WHEN c_custkey % 2 = 0 THEN 'later' ELSE '' END AS delta_summary
  FROM customer WHERE c_custkey % 4 < 3 OR c_custkey % 6 = 3
)"""


@query(f"WITH {_MERGED} SELECT * FROM merged")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of two rounds, the second filling and overriding the first."""
    return tables.merge_payloads(*_payloads(spark, sf_dir))


@query(f"""
WITH {_MERGED}
SELECT c_name AS canonical_label FROM customer
WHERE c_name NOT IN (SELECT canonical_label FROM merged WHERE briefing <> '')
""")
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that have no text after both rounds."""
    stories = a.table(spark, sf_dir, "customer").select(F.col("c_name").alias("canonical_label"))
    return tables.missing_payloads(stories, tables.merge_payloads(*_payloads(spark, sf_dir)))
