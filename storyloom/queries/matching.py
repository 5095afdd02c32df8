"""Continuing stories and new story ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.coverage import recent_stories as find_recent
from storyloom.operators.ranking import number_rows
from storyloom.operators.story_days import days_from_tables
from storyloom.plans.tracking import History, StoryDays, Tracked, match_groups, stories_by_label, track
from storyloom.plans.tracking import tracking_counters as count_tracked
from storyloom.queries import adapters as a
from storyloom.queries.registry import query
from storyloom.session import run_folder
from storyloom.sources.replies import group_replies as read_groups
from storyloom.sources.replies import match_replies as read_matches
from storyloom.sources.state import StateStore

_TODAY = "1998-06-01"


def _kind(number) -> Column:
    return F.concat(
        F.when(number % 2 == 0, F.lit("segment ")).otherwise(F.lit("crash ")), number.cast("string")
    )


_MATCH = f"""{a.HIST},
stories AS (
  SELECT c_custkey AS story_id, CASE WHEN c_custkey % 97 % 2 = 0 THEN 'segment ' ELSE 'crash ' END
         || (c_custkey % 97) AS canonical_label FROM customer
),
groups AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN 'segment ' ELSE 'crash ' END || c_custkey AS group_label,
         CASE c_custkey % 4 WHEN 0 THEN 'segment ' || (c_custkey % 48 * 2)
                            WHEN 1 THEN 'crash ' || (c_custkey % 48 * 2 + 1)
                            WHEN 2 THEN 'no such label' END AS proposed
  FROM customer
),
recent AS (
  SELECT canonical_label, story_id
  FROM (SELECT s.canonical_label, s.story_id, max(h.date) AS last_daily
        FROM hist h JOIN stories s USING (story_id)
        WHERE h.date >= DATE '{_TODAY}' - 14 AND h.date < DATE '{_TODAY}' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY canonical_label ORDER BY last_daily DESC, story_id DESC) = 1
),
alive AS (
  SELECT s.canonical_label, s.story_id
  FROM (SELECT story_id, min(date) AS first_seen, max(date) AS last_seen FROM hist GROUP BY story_id) b
  JOIN stories s USING (story_id)
  WHERE b.last_seen >= DATE '{_TODAY}' - 14 AND b.first_seen <= DATE '{_TODAY}'
  QUALIFY row_number() OVER (PARTITION BY canonical_label ORDER BY last_seen DESC, story_id DESC) = 1
)"""


@query(f"""
WITH {_MATCH},
matched AS (
  SELECT g.group_label, CASE WHEN NOT (starts_with(g.group_label, 'crash') AND starts_with(g.proposed, 'crash'))
                   OR (split_part(g.group_label, ' ', 2) = split_part(g.proposed, ' ', 2))
                THEN r.canonical_label END AS matched_label, r.story_id AS recent_id
  FROM groups g LEFT JOIN recent r ON r.canonical_label = g.proposed
)
SELECT m.group_label, m.matched_label,
       CASE WHEN m.matched_label IS NOT NULL THEN m.recent_id ELSE a.story_id END AS story_id
FROM matched m LEFT JOIN alive a ON a.canonical_label = m.group_label
""")
def match_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups continued from recent stories, else from a story of the same label."""
    customers = a.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    stories = customers.select(key.alias("story_id"), _kind(key % 97).alias("canonical_label"))
    groups = customers.select(_kind(key).alias("group_label"))
    proposed = (
        F.when(key % 4 == 0, _kind(key % 48 * 2))
        .when(key % 4 == 1, _kind(key % 48 * 2 + 1))
        .when(key % 4 == 2, F.lit("no such label"))
    )
    matches = customers.select(
        _kind(key).alias("today_label"), proposed.alias("canonical_label")
    ).filter(F.col("canonical_label").isNotNull())
    daily = a.history_articles(spark, sf_dir).select("story_id", "date")
    today = F.lit(_TODAY).cast("date")
    matched = match_groups(groups, matches, find_recent(stories, daily, today))
    by_label = stories_by_label(stories, daily, today)
    return matched.join(
        by_label, F.col("group_label") == F.col("canonical_label"), "left"
    ).select(
        "group_label",
        "matched_label",
        F.coalesce("matched_id", "label_id").alias("story_id"),
    )


@query(f"""
WITH {a.ART},
labels AS (SELECT canonical_label, min(ordinal) AS first_ordinal FROM art GROUP BY canonical_label)
SELECT canonical_label, 1000 + row_number() OVER (ORDER BY first_ordinal) AS story_id FROM labels
""")
def new_story_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for new stories above a high-water mark, in order of first appearance."""
    labels = a.articles(spark, sf_dir).groupBy("canonical_label").agg(
        F.min("ordinal").alias("first_ordinal")
    )
    numbered = number_rows(labels, [F.col("first_ordinal")])
    return numbered.select("canonical_label", (F.col("position") + 1000).alias("story_id"))


_RUN_DATE = "2024-01-30"

# Users with an odd id are stories of their own label; those with an even id were stories
# of another label, and every third of them is proposed to continue the next user's story.
_DAY = f"""{a.ART}, {a.ART_DAILY},
batch AS (SELECT * FROM art WHERE date = DATE '{_RUN_DATE}'),
past AS (SELECT * FROM art WHERE date < DATE '{_RUN_DATE}'),
seen AS (
  SELECT story_id, min(date) AS first_seen, max(date) AS last_seen FROM past GROUP BY story_id
),
groups AS (
  SELECT story_label, story_id AS user_id, min(ordinal) AS first_ordinal,
         count(DISTINCT source) AS source_count, count(*) AS article_count,
         avg(importance) AS importance_avg
  FROM batch GROUP BY ALL
),
resolved AS (
  SELECT g.*, CASE WHEN g.user_id % 2 = 0 AND g.user_id % 3 = 0
                    AND m.last_seen >= DATE '{_RUN_DATE}' - 14 THEN m.story_id
                   WHEN s.last_seen >= DATE '{_RUN_DATE}' - 14 THEN s.story_id END AS known_id,
         g.user_id % 2 = 0 AND g.user_id % 3 = 0
           AND m.last_seen >= DATE '{_RUN_DATE}' - 14 IS TRUE AS matched
  FROM groups g
  LEFT JOIN seen s ON s.story_id = g.user_id AND g.user_id % 2 = 1
  LEFT JOIN seen m ON m.story_id = g.user_id + 1
),
numbered AS (
  SELECT *, coalesce(known_id, (SELECT max(story_id) FROM seen)
           + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY first_ordinal)) AS new_id
  FROM resolved
),
before AS (
  SELECT story_id, count(DISTINCT source) AS previous_count, date FROM past GROUP BY story_id, date
  QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY date DESC) = 1
)"""


_TRACKED_DAY = f"""
WITH {_DAY}
SELECT b.id, n.new_id AS story_id,
       CASE WHEN n.matched THEN 'user ' || (n.user_id + 1) ELSE n.story_label END AS canonical_label,
       CASE WHEN p.previous_count IS NULL THEN 'new' WHEN n.source_count - p.previous_count > 1 THEN 'up'
            WHEN n.source_count - p.previous_count < -1 THEN 'down' ELSE 'steady' END AS trend,
       n.source_count, round(n.importance_avg, 6) AS importance_avg,
       coalesce((SELECT string_agg(q.title, '; ' ORDER BY q.rank) FROM (
          SELECT title, story_id, row_number() OVER (PARTITION BY story_id
                 ORDER BY date DESC, published_at DESC, CAST(id AS VARCHAR)) AS rank FROM past) q
        WHERE q.story_id = n.new_id AND q.rank <= 3), '') AS recent
FROM batch b JOIN numbered n USING (story_label)
LEFT JOIN before p ON p.story_id = n.new_id
"""


@query(_TRACKED_DAY)
def track_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole tracking run: the last day's articles against all days before it."""
    return _tracked_rows(_run_of_day(spark, sf_dir, lambda history: history))


@query(_TRACKED_DAY)
def track_day_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run, reading the rows kept per story and day from a state folder."""

    def kept(history: History) -> StoryDays:
        store = StateStore(spark, f"{run_folder(spark)}/state-{uuid.uuid4().hex}")
        with store.transaction():
            rows = days_from_tables(history.stories, history.daily, history.observations, history.articles)
            store.replace_dates("story_days", rows)
            store.set_counter("story_id", history.last_id())
        return StoryDays(store)

    return _tracked_rows(_run_of_day(spark, sf_dir, kept))


@query(f"""
WITH {_DAY}
SELECT count(*) AS labels, count(DISTINCT new_id) AS stories,
       count(*) FILTER (known_id IS NULL) AS new_stories
FROM numbered
""")
def tracking_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the run, stories they went to, and new ones among them."""
    return count_tracked(_run_of_day(spark, sf_dir, lambda history: history).stories)


# Users whose id leaves 1 or 2 by six are proposed as one group, the later one first.
_GROUPED = f"""{a.ART}, {a.ART_DAILY},
batch AS (
  SELECT *, CASE WHEN story_id % 6 = 2 THEN story_id - 1 ELSE story_id END AS owner,
         story_id % 6 IN (1, 2) AS proposed
  FROM art WHERE date = DATE '{_RUN_DATE}'
),
past AS (SELECT * FROM art WHERE date < DATE '{_RUN_DATE}'),
seen AS (
  SELECT story_id, min(date) AS first_seen, max(date) AS last_seen FROM past GROUP BY story_id
),
groups AS (
  SELECT owner, bool_or(proposed) AS grouped, min(ordinal) AS first_ordinal,
         count(DISTINCT source) AS source_count, avg(importance) AS importance_avg
  FROM batch GROUP BY owner
),
resolved AS (
  SELECT g.*, CASE WHEN g.owner % 6 = 0 AND m.last_seen >= DATE '{_RUN_DATE}' - 14 THEN m.story_id
                   WHEN s.last_seen >= DATE '{_RUN_DATE}' - 14 THEN s.story_id END AS known_id,
         g.owner % 6 = 0 AND m.last_seen >= DATE '{_RUN_DATE}' - 14 IS TRUE AS matched,
         CASE WHEN g.grouped THEN g.owner ELSE g.first_ordinal END AS place
  FROM groups g
  LEFT JOIN seen s ON s.story_id = g.owner AND g.owner % 2 = 1
  LEFT JOIN seen m ON m.story_id = g.owner + 1
),
numbered AS (
  SELECT *, coalesce(known_id, (SELECT max(story_id) FROM seen)
           + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY NOT grouped, place)) AS new_id
  FROM resolved
)"""


@query(f"""
WITH {_GROUPED}
SELECT b.id, n.new_id AS story_id,
       CASE WHEN n.matched THEN 'user ' || (n.owner + 1) ELSE 'user ' || n.owner END AS canonical_label,
       n.source_count, round(n.importance_avg, 6) AS importance_avg,
       row_number() OVER (ORDER BY NOT n.grouped, n.place, n.grouped AND b.story_id % 6 = 1, b.ordinal) AS place
FROM batch b JOIN numbered n USING (owner)
""")
def track_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracking run under group proposals, with the place of each article in all reports."""
    user = F.col("story_id")
    base = F.when(user % 6 == 2, user - 1).otherwise(user)
    name = lambda number: F.concat(F.lit("user "), number.cast("string"))
    rows = a.articles(spark, sf_dir).where(F.col("date") == F.lit(_RUN_DATE).cast("date"))
    groups = rows.where((user % 6).isin(1, 2)).select(base.alias("group_pos")).distinct()
    number = F.col("group_pos")
    groups = groups.withColumn("canonical_label", name(number)).withColumn("labels", F.array(name(number + 1), name(number)))
    out = _run_of_day(spark, sf_dir, lambda history: history, groups)
    metrics = out.stories.select("group_label", "source_count", "importance_avg")
    return out.articles.join(metrics, "group_label").select(
        "id", "story_id", "canonical_label", "source_count",
        F.round("importance_avg", 6).alias("importance_avg"), F.col("ordinal").cast("bigint").alias("place"),
    )


def _run_of_day(
    spark: SparkSession,
    sf_dir: str,
    kept: Callable[[History], History | StoryDays],
    groups: DataFrame | None = None,
) -> Tracked:
    rows = a.articles(spark, sf_dir)
    day = F.lit(_RUN_DATE).cast("date")
    user = F.col("story_id")
    past = rows.filter(F.col("date") < day)
    label = F.when(user % 2 == 1, F.col("story_label")).otherwise(F.concat(F.lit("former "), "story_label"))
    observed = past.select("story_id", "date", F.lit("").alias("summary"), F.lit(None).cast("string").alias("delta_summary"))
    history = History(
        past.select("story_id", label.alias("canonical_label")).distinct(),
        past.groupBy("story_id", "date").agg(F.count_distinct("source").alias("source_count")),
        observed.distinct(),
        past.withColumn("id", F.col("id").cast("string")),
    )
    following = F.concat(F.lit("user "), (user + 1).cast("string"))
    matches = rows.select(
        F.col("story_label").alias("today_label"),
        F.when(user % 6 == 0, following).otherwise(F.lit("NEW")).alias("canonical_label"),
    ).distinct()
    batch = rows.filter(F.col("date") == day).withColumn("text", F.lit("")).drop(
        "story_id", "canonical_label", "date"
    )
    return track(batch, kept(history), _RUN_DATE, groups, matches)


def _tracked_rows(out) -> DataFrame:
    metrics = out.stories.select("group_label", "source_count", "importance_avg")
    context = F.coalesce(F.col("previous_context.recent_articles"), F.array())
    return out.articles.join(metrics, "group_label").select(
        "id", "story_id", "canonical_label", "trend", "source_count",
        F.round("importance_avg", 6).alias("importance_avg"),
        F.array_join(F.transform(context, lambda r: r["title"]), "; ").alias("recent"),
    )


def _label_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers with their names, 40 to a reply."""
    return a.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", F.floor(F.col("p_partkey") / 40).alias("reply_no")
    )


def _reply_of(rows: DataFrame, name: str, element: Column) -> DataFrame:
    """One reply per 40 parts, holding their elements in order."""
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", element.alias("e"))))
    listed = F.array_join(F.transform(ordered, lambda r: r["e"]), ",")
    return rows.groupBy("reply_no").agg(
        F.concat(F.lit(f'{{"{name}":['), listed, F.lit("]}")).alias("reply")
    )


@query("""
SELECT trim(p_name) AS canonical_label, p_brand AS labels, count(*) AS proposals
FROM part WHERE p_partkey % 5 <> 1 AND p_partkey % 5 <> 2
GROUP BY ALL
""")
def group_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group proposals read from replies; nameless ones and ones without a list are left out."""
    key = F.col("p_partkey")
    element = (
        F.when(key % 5 == 1, F.lit('{"canonical_label":" ","labels":["x"]}'))
        .when(key % 5 == 2, F.lit('{"canonical_label":"x","labels":"x"}'))
        .otherwise(
            F.concat(
                F.lit('{"canonical_label":" '), "p_name", F.lit('","labels":["'), "p_brand",
                F.lit('",5,null]}'),
            )
        )
    )
    rows = read_groups(_reply_of(_label_elements(spark, sf_dir), "groups", element))
    return rows.groupBy("canonical_label", F.array_join("labels", "|").alias("labels")).agg(
        F.count("*").alias("proposals")
    )


@query("""
SELECT p_name AS today_label, arg_max(p_brand, p_partkey) AS canonical_label
FROM part WHERE p_partkey % 4 <> 3 GROUP BY p_name
""")
def match_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match proposals read from replies; the last one for a label counts."""
    key = F.col("p_partkey")
    element = F.when(key % 4 == 3, F.lit('{"today_label":7,"canonical_label":"x"}')).otherwise(
        F.concat(
            F.lit('{"today_label":"'), "p_name", F.lit('","canonical_label":"'), "p_brand", F.lit('"}')
        )
    )
    return read_matches(_reply_of(_label_elements(spark, sf_dir), "matches", element))
