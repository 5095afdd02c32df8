"""Stories, sections, texts and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.constants import (
    FALLBACK_DELTAS,
    GAZETTEER,
    GLOBAL_KEYWORDS,
    LOW_INTEREST_KEYWORDS,
    THEMES,
    TREND_ICONS,
    TREND_WORDS,
)
from storyloom.functions.render import one_decimal, source_summary
from storyloom.functions.stories import theme_summary
from storyloom.functions.text import fold
from storyloom.operators import rollup as roll
from storyloom.operators.locations import place_scores as score_places
from storyloom.operators.locations import story_locations
from storyloom.operators.sections import edition_sections as regroup
from storyloom.operators.sections import lead_stories as leads
from storyloom.plans import briefing as brief
from storyloom.plans.digest import LINE_ORDER as DIGEST_ORDER
from storyloom.plans.digest import digest_lines as lines_of_digest
from storyloom.plans.digest import digest_stories as stories_of_digest
from storyloom.plans.edition import edition_counts as count_sections
from storyloom.plans.edition import edition_rows as rows_of_edition
from storyloom.queries import adapters as a
from storyloom.queries.registry import query
from storyloom.session import cut
from storyloom.sources.replies import briefing_replies as read_briefings

_STAMP = "2024-01-31 06:00"
_GLOBAL_N = 10


def _case(column: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE '{default}' END"


_KEYWORDS = " OR ".join(f"contains(words, '{k}')" for k in LOW_INTEREST_KEYWORDS)
_THEME_RANK = f"list_position({a._sql_list(THEMES)}, theme)"

STORIES = f"""{a.TRACKED},
theme_counts AS (
  SELECT canonical_label, theme FROM tracked GROUP BY canonical_label, theme
  QUALIFY row_number() OVER (PARTITION BY canonical_label
                             ORDER BY count(*) DESC, sum(importance) DESC, {_THEME_RANK}) = 1
),
grouped AS (
  SELECT canonical_label, min(ordinal) AS first_ordinal, arg_min(trend, ordinal) AS trend,
         arg_min(story_id, ordinal) AS story_id, count(DISTINCT source) AS source_count,
         count(*) AS article_count, avg(importance) AS importance_avg,
         min(context_summary) AS context_summary, min(observation_id) AS observation_id,
         max(reported_ts) AS latest_reported, list_sort(list(DISTINCT theme)) AS themes,
         arg_min(source, ({{'u': reported_ts IS NULL, 'a': -epoch_us(reported_ts), 'o': ordinal}})) AS lead_source,
         arg_min(title, ({{'u': reported_ts IS NULL, 'a': -epoch_us(reported_ts), 'o': ordinal}})) AS lead_title,
         arg_min(published_at, ordinal) FILTER (published_at <> '') AS first_published_at,
         bool_or({_KEYWORDS}) AS low_interest
  FROM (SELECT *, lower(canonical_label || ' ' || title || ' ' || description) AS words FROM tracked)
  GROUP BY canonical_label
),
stories AS (
  SELECT *, importance_avg * 100 + source_count * 12
            + CASE trend WHEN 'up' THEN 2 WHEN 'new' THEN 1 WHEN 'down' THEN -1 ELSE 0 END AS score
  FROM grouped JOIN theme_counts USING (canonical_label)
)"""

_NO_SPORTS = "NOT list_contains(themes, 'Sports')"
_NO_NICHE = "NOT list_has_any(themes, ['Tech', 'Science'])"
_IS_LEAD = f"""{_NO_SPORTS} AND NOT low_interest
  AND ({_NO_NICHE} OR (importance_avg >= 4.5 AND source_count >= 3))"""
_ORDER = "ORDER BY score DESC, first_ordinal"

SECTIONS = f"""{STORIES},
lead AS (SELECT *, row_number() OVER ({_ORDER}) AS rank FROM stories WHERE {_IS_LEAD} QUALIFY rank <= 3),
politics AS (
  SELECT *, row_number() OVER ({_ORDER}) AS rank FROM stories
  WHERE {_NO_SPORTS} AND {_NO_NICHE}
    AND list_has_any(themes, ['Geopolitics & War', 'USA Politics', 'Dutch Politics'])
    AND canonical_label NOT IN (SELECT canonical_label FROM lead)
  QUALIFY rank <= {_GLOBAL_N}
),
economy AS (
  SELECT *, row_number() OVER ({_ORDER}) AS rank FROM stories
  WHERE {_NO_SPORTS} AND {_NO_NICHE} AND list_contains(themes, 'Economy')
    AND canonical_label NOT IN (SELECT canonical_label FROM lead UNION ALL SELECT canonical_label FROM politics)
  QUALIFY rank <= 6
),
other AS (
  SELECT *, row_number() OVER ({_ORDER}) AS rank FROM stories
  WHERE {_NO_SPORTS} AND {_NO_NICHE} AND list_contains(themes, 'Other') AND NOT low_interest
    AND (importance_avg >= 2.5 OR source_count >= 2)
    AND canonical_label NOT IN (SELECT canonical_label FROM lead UNION ALL SELECT canonical_label FROM politics
                                UNION ALL SELECT canonical_label FROM economy)
  QUALIFY rank <= 6
),
shown AS (
  SELECT 1 AS section_rank, * FROM lead UNION ALL SELECT 2, * FROM politics
  UNION ALL SELECT 3, * FROM economy UNION ALL SELECT 4, * FROM other
)"""

_LATEST = "coalesce(strftime(latest_reported, '%Y-%m-%d %H:%M UTC'), 'unknown time')"
_IMPORTANCE = "CAST(CAST(round(importance_avg, 1) AS DECIMAL(20, 1)) AS VARCHAR)"
_SUMMARY = f"""array_to_string(list_filter({a._sql_list(THEMES)},
             lambda t: list_contains(themes, t)), ' / ')"""
_DELTA = f"""CASE WHEN context_summary IS NULL THEN '{FALLBACK_DELTAS[None]}'
     WHEN trend = 'up' THEN '{FALLBACK_DELTAS["up"]}' WHEN trend = 'down' THEN '{FALLBACK_DELTAS["down"]}'
     ELSE '{FALLBACK_DELTAS["other"].replace("'", "''")}' END"""

# Replies cover some stories; the retry some of those left out.
FILLED = f"""{SECTIONS},
filled AS (
  SELECT *, CASE story_id % 4 WHEN 0 THEN 'Briefing of ' || canonical_label
              WHEN 1 THEN 'Second briefing of ' || canonical_label
              ELSE canonical_label || ' is included based on ' || source_count || ' '
                   || CASE WHEN source_count > 1 THEN 'sources' ELSE 'source' END
                   || ', with the latest report at ' || {_LATEST} || '. The lead item is from '
                   || lead_source || ': ' || lead_title || '.' END AS briefing,
         CASE WHEN story_id % 4 IN (0, 1) AND story_id % 3 = 0 THEN 'Delta ' || story_id
              ELSE {_DELTA} END AS delta
  FROM shown
)"""


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll.with_score(roll.story_metrics(a.tracked(spark, sf_dir)))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief.briefing_stories(a.tracked(spark, sf_dir), 3, _GLOBAL_N)


def _replies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and retry payloads for the given stories."""
    user = F.col("story_id")
    delta = F.when(user % 3 == 0, F.concat(F.lit("Delta "), user.cast("string"))).otherwise(F.lit(" "))
    first = rows.select(
        "canonical_label",
        F.when(user % 4 == 0, F.concat(F.lit(" Briefing of "), "canonical_label"))
        .otherwise(F.lit("\n")).alias("briefing"),
        F.when(user % 4 < 2, delta).alias("delta_summary"),
    )
    second = F.concat(F.lit("Second briefing of "), "canonical_label")
    retry = rows.select(
        "canonical_label",
        F.when(user % 4 == 1, second).otherwise(F.lit("")).alias("briefing"),
        F.lit("").alias("delta_summary"),
    )
    return first, retry


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = cut(_sections(spark, sf_dir))
    labels = a.articles(spark, sf_dir).select("canonical_label", "story_id").distinct()
    return cut(brief.fill_texts(picked, *_replies(labels)))


@query(f"""
WITH {STORIES}
SELECT canonical_label, first_ordinal, theme, array_to_string(themes, '|') AS themes, trend,
       source_count, article_count, round(importance_avg, 6) AS importance_avg, context_summary,
       observation_id, story_id, strftime(latest_reported, '%Y-%m-%d %H:%M UTC') AS latest_reported,
       first_published_at, lead_source, lead_title, CAST(low_interest AS INTEGER) AS low_interest
FROM stories
""")
def story_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per story with everything the reports need."""
    rows = roll.story_rollup(a.tracked(spark, sf_dir))
    return rows.select(
        "canonical_label", "first_ordinal", "theme", F.array_join("themes", "|").alias("themes"),
        "trend", "source_count", "article_count",
        F.round("importance_avg", 6).alias("importance_avg"),
        F.col("previous_context.summary").alias("context_summary"),
        F.element_at("observation_ids", 1).alias("observation_id"), "story_id",
        F.concat(F.substring(F.col("latest_reported").cast("string"), 1, 16), F.lit(" UTC")).alias("latest_reported"),
        "first_published_at", F.col("lead.source").alias("lead_source"),
        F.col("lead.title").alias("lead_title"),
        F.col("low_interest").cast("int").alias("low_interest"),
    )


@query(f"WITH {STORIES} SELECT canonical_label, round(score, 6) AS score, first_ordinal FROM stories")
def story_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stories in ranked order."""
    rows = roll.rank_stories(roll.story_metrics(a.tracked(spark, sf_dir)))
    return rows.select("canonical_label", F.round("score", 6).alias("score"), "first_ordinal")


@query(f"WITH {SECTIONS} SELECT canonical_label, round(score, 6) AS score FROM lead")
def lead_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that open the briefing."""
    rows = leads(_stories(spark, sf_dir))
    return rows.select("canonical_label", F.round("score", 6).alias("score"))


@query(f"""
WITH {SECTIONS}
SELECT CAST(section_rank AS BIGINT) AS section_rank, rank, canonical_label, round(score, 6) AS score FROM shown
""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of all briefing sections; a story is shown once."""
    rows = _sections(spark, sf_dir)
    return rows.select(
        F.col("section_rank").cast("bigint").alias("section_rank"),
        F.col("rank").cast("bigint").alias("rank"), "canonical_label",
        F.round("score", 6).alias("score"),
    )


@query(f"""
WITH {SECTIONS}
SELECT CASE trend WHEN 'new' THEN 'NEW TODAY' WHEN 'up' THEN 'DEVELOPING STORIES'
         WHEN 'steady' THEN 'CONTINUING WATCH' ELSE 'COOLING / LOWER PRIORITY' END AS edition_title,
       count(*) AS stories
FROM shown GROUP BY ALL
""")
def edition_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed stories per movement section."""
    rows = count_sections(regroup(_sections(spark, sf_dir)))
    return rows.select("edition_title", "stories")


@query(f"""
WITH {a.ART},
counts AS (SELECT story_label, source, count(*) AS n, min(ordinal) AS first FROM art GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY story_label ORDER BY n DESC, first) AS rank,
                  count(*) OVER (PARTITION BY story_label) AS total FROM counts)
SELECT story_label, 'Sources: ' || string_agg(source, ', ' ORDER BY rank) FILTER (rank <= 3)
       || CASE WHEN max(total) > 3 THEN ' +' || (max(total) - 3) ELSE '' END AS sources
FROM ranked GROUP BY story_label
""")
def source_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent sources of every story label."""
    rows = roll.top_sources(a.articles(spark, sf_dir), ["story_label"], 3)
    return rows.select("story_label", source_summary("top_sources", "distinct_sources", 3).alias("sources"))


@query(f"""
WITH {FILLED}
SELECT CAST(section_rank AS BIGINT) AS section_rank, rank, canonical_label, {_IMPORTANCE} AS importance,
       {_SUMMARY} AS themes, briefing, delta
FROM filled
""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed stories with their texts, made up where no reply has one."""
    rows = _filled(spark, sf_dir)
    return rows.select(
        F.col("section_rank").cast("bigint").alias("section_rank"),
        F.col("rank").cast("bigint").alias("rank"), "canonical_label",
        one_decimal("importance_avg").alias("importance"), theme_summary("themes").alias("themes"),
        "briefing", "delta",
    )


_REPORTED = """coalesce(strftime(reported_ts, '%Y-%m-%d %H:%M UTC'), nullif(published_at, ''), 'unknown time')"""
_SOURCE_LINE = f"""'- ' || source || ' — reported ' || {_REPORTED} || ' — '
  || CASE WHEN url <> '' THEN '[' || title || '](' || url || ')' ELSE title END"""
_AGE = "coalesce(epoch_us(TIMESTAMP '9999-12-31') - epoch_us(reported_ts), 0)"


@query(f"""
WITH {FILLED},
story_lines AS (
  SELECT section_rank, rank, unnest(range(0, 8)) AS block, unnest([
    '## ' || rank || '. ' || {_case('trend', TREND_WORDS, '')} || ' ' || canonical_label,
    '_' || {_SUMMARY} || ' — importance ' || {_IMPORTANCE} || ' — ' || source_count || ' '
      || CASE WHEN source_count > 1 THEN 'sources' ELSE 'source' END || ' — latest reported ' || {_LATEST} || '_',
    '', '**What changed today:** ' || delta, '', briefing, '', 'Sources:']) AS line
  FROM filled
),
heads AS (
  SELECT section_rank, 0 AS rank, unnest(range(0, 4)) AS block,
         unnest(['---', '', '# ' || ['', 'Politics', 'Economy', 'Other Important Stories'][section_rank], '']) AS line
  FROM filled WHERE section_rank > 1 AND rank = 1
),
every AS (
  SELECT section_rank, rank, block, 0 AS undated, 0 AS age, 0 AS item_order, line FROM story_lines
  UNION ALL SELECT section_rank, rank, block, 0, 0, 0, line FROM heads
  UNION ALL SELECT section_rank, rank, 300, 0, 0, 0, '' FROM filled
  UNION ALL SELECT section_rank, f.rank, 100, CAST(reported_ts IS NULL AS INTEGER), {_AGE}, ordinal, {_SOURCE_LINE}
  FROM filled f JOIN tracked t USING (canonical_label)
  UNION ALL SELECT 0, 0, unnest(range(0, 3)), 0, 0, 0, unnest(['# Top Developments', '_{_STAMP}_', ''])
)
SELECT CAST(section_rank AS BIGINT) AS section_rank, CAST(rank AS BIGINT) AS rank,
       CAST(block AS BIGINT) AS block, CAST(undated AS BIGINT) AS undated, CAST(age AS BIGINT) AS age,
       CAST(item_order AS BIGINT) AS item_order, line
FROM every
""")
def briefing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefing as lines with their place in the reading order."""
    rows = brief.briefing_lines(_filled(spark, sf_dir), a.tracked(spark, sf_dir), _STAMP)
    keys = [F.col(c).cast("bigint").alias(c) for c in brief.LINE_ORDER]
    return rows.select(*keys, "line")


_DIGEST = f"""{a.TRACKED},
digest AS (
  SELECT theme, canonical_label AS label, max(importance) AS max_importance,
         arg_min(trend, ordinal) AS trend, min(ordinal) AS first_ordinal, count(*) AS article_count,
         {_THEME_RANK} AS theme_rank
  FROM tracked GROUP BY theme, canonical_label
)"""


@query(f"""
WITH {_DIGEST}
SELECT theme, label, CAST(max_importance AS BIGINT) AS max_importance, trend, first_ordinal, article_count
FROM digest
""")
def digest_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories per theme with their highest importance."""
    rows = stories_of_digest(a.tracked(spark, sf_dir))
    return rows.select(
        "theme", "label", F.col("max_importance").cast("bigint").alias("max_importance"), "trend",
        "first_ordinal", "article_count",
    )


DIGEST_LINES = f"""{_DIGEST},
every AS (
  SELECT theme_rank, -max_importance AS minus_importance, first_ordinal, unnest([0, 1]) AS block,
         0 AS undated, 0 AS age, 0 AS item_order,
         unnest(['### ' || {_case('trend', TREND_ICONS, '')} || ' ' || label
                 || ' _(importance ' || max_importance || ')_', '']) AS line
  FROM digest
  UNION ALL SELECT theme_rank, -max_importance, first_ordinal, 300, 0, 0, 0, '' FROM digest
  UNION ALL SELECT theme_rank, -max_importance, first_ordinal, 100, CAST(reported_ts IS NULL AS INTEGER),
                   {_AGE}, ordinal, {_SOURCE_LINE}
  FROM tracked t JOIN digest d ON d.theme = t.theme AND d.label = t.canonical_label
  UNION ALL SELECT theme_rank, -1000000, -1, unnest([0, 1]), 0, 0, 0, unnest(['## ' || theme, ''])
  FROM (SELECT DISTINCT theme, theme_rank FROM digest)
  UNION ALL SELECT 0, 0, 0, unnest(range(0, 5)), 0, 0, 0, unnest(['# News Digest',
    '_Generated {_STAMP} — ' || (SELECT count(*) FROM tracked) || ' articles_', '', '---', ''])
)"""


@query(f"""
WITH {DIGEST_LINES}
SELECT CAST(theme_rank AS BIGINT) AS theme_rank, CAST(minus_importance AS BIGINT) AS minus_importance,
       CAST(first_ordinal AS BIGINT) AS first_ordinal, CAST(block AS BIGINT) AS block,
       CAST(undated AS BIGINT) AS undated, CAST(age AS BIGINT) AS age,
       CAST(item_order AS BIGINT) AS item_order, line
FROM every
""")
def digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all articles as lines with their place in the reading order."""
    rows = lines_of_digest(a.tracked(spark, sf_dir), _STAMP)
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in DIGEST_ORDER], "line")


def _sql_aliases(gazetteer) -> str:
    rows = []
    for rank, (name, lat, lon, scope, aliases) in enumerate(gazetteer):
        for alias in aliases:
            pattern = alias.replace(".", "\\.").replace("-", "\\-")
            rows.append(f"({rank}, '{name}', {float(lat)}::DOUBLE, {float(lon)}::DOUBLE, '{scope}', '{alias}', '(^|[^a-z0-9]){pattern}([^a-z0-9]|$)')")
    return ", ".join(rows)


def _sql_scores(articles: str, gazetteer) -> str:
    """Place scores of a relation (canonical_label, title, description)."""
    return f"""
aliases AS (SELECT * FROM (VALUES {_sql_aliases(gazetteer)}) v(place_rank, place, lat, lon, scope, alias, pattern)),
{_sql_found(articles)}"""


def _sql_found(articles: str) -> str:
    """Place scores by the relation aliases (place_rank, place, lat, lon, scope, alias, pattern)."""
    fold = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
    return f"""
in_articles AS (
  SELECT DISTINCT canonical_label, place_rank, alias
  FROM (SELECT canonical_label, {fold.format("title || ' ' || description")} AS words FROM {articles}) x
  JOIN aliases ON contains(words, alias) AND regexp_matches(words, pattern)
),
in_labels AS (
  SELECT canonical_label, place_rank, alias
  FROM (SELECT DISTINCT canonical_label, {fold.format("canonical_label")} AS words FROM {articles}) x
  JOIN aliases ON contains(words, alias) AND regexp_matches(words, pattern)
),
scores AS (
  SELECT canonical_label, place_rank, any_value(place) AS label, any_value(scope) AS scope,
         any_value(lat) AS lat, any_value(lon) AS lon, CAST(sum(score) AS BIGINT) AS score
  FROM (SELECT canonical_label, place_rank, 1 AS score FROM in_articles
        UNION ALL SELECT canonical_label, place_rank, 3 FROM in_labels)
  JOIN (SELECT DISTINCT place_rank, place, lat, lon, scope FROM aliases) USING (place_rank)
  GROUP BY canonical_label, place_rank
)"""


def _sql_locations(articles: str) -> str:
    keywords = " OR ".join(f"contains(words, '{k}')" for k in GLOBAL_KEYWORDS)
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY canonical_label ORDER BY score DESC, place_rank) AS rank,
         count(*) OVER (PARTITION BY canonical_label) AS total,
         max(score) OVER (PARTITION BY canonical_label) AS top_score,
         nth_value(score, 2) OVER (PARTITION BY canonical_label ORDER BY score DESC, place_rank
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_score
  FROM scores
),
tops AS (
  SELECT canonical_label, max(total) AS total, max(label) FILTER (rank = 1) AS top,
         max(scope) FILTER (rank = 1) AS top_scope, max(top_score) AS top_score,
         max(second_score) AS second_score,
         string_agg(label, ' / ' ORDER BY rank) FILTER (rank <= 3) AS joined,
         string_agg(label || ' ' || CAST(lat AS DECIMAL(9, 4)) || ' ' || CAST(lon AS DECIMAL(9, 4)), '; ' ORDER BY rank)
           FILTER (rank = 1 OR rank <= 3 AND top_score < 2 * second_score) AS spots
  FROM ranked GROUP BY canonical_label
),
texts_of AS (
  SELECT canonical_label, bool_or({keywords}) AS keyword, bool_or(theme = 'Economy') AS economy
  FROM (SELECT canonical_label, theme, lower(canonical_label || ' ' || title || ' ' || description) AS words
        FROM {articles}) GROUP BY canonical_label
),
located AS (
  SELECT t.canonical_label,
         CASE WHEN top IS NOT NULL AND (total = 1 OR top_score >= 2 * second_score) THEN top_scope
              WHEN top IS NOT NULL THEN 'multi-region'
              WHEN keyword OR economy THEN 'global' ELSE 'unknown' END AS scope,
         CASE WHEN top IS NOT NULL AND (total = 1 OR top_score >= 2 * second_score) THEN top
              WHEN top IS NOT NULL THEN joined || CASE WHEN total > 3 THEN ' +' || (total - 3) ELSE '' END
              WHEN keyword OR economy THEN 'Global' ELSE 'Unknown' END AS label,
         CASE WHEN top IS NOT NULL AND (total = 1 OR top_score >= 2 * second_score) AND top_score >= 3 THEN 'high'
              WHEN top IS NOT NULL OR keyword OR economy THEN 'medium' ELSE 'low' END AS confidence,
         CASE WHEN top IS NULL THEN 0 WHEN total = 1 OR top_score >= 2 * second_score THEN 1
              ELSE least(total, 3) END AS points, coalesce(spots, '') AS spots
  FROM texts_of t LEFT JOIN tops p USING (canonical_label)
)"""


@query(f"""
WITH {a.ART}, {_sql_scores("art", GAZETTEER)}
SELECT canonical_label, CAST(place_rank AS BIGINT) AS place_rank, label, scope, score FROM scores
""")
def place_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places mentioned by the stories of the events, with their scores."""
    rows = score_places(a.articles(spark, sf_dir))
    return rows.select(
        "canonical_label", F.col("place_rank").cast("bigint").alias("place_rank"), "label", "scope", "score"
    )


# Places named after words of the documents, so that whole texts are searched.
TEXT_PLACES = [
    ("Thereland", 10.0, 20.0, "national", ["there", "therin", "the on"]),
    ("Ersville", -5.5, 7.25, "local", ["ersville", "ers", "en la"]),
    ("Landau", 49.2, 8.1, "local", ["landau", "der", "und er"]),
    ("Parador", 0.0, 0.0, "national", ["para", "que"]),
    *GAZETTEER,
]


def _text_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("source", F.lit(" "), "language", F.lit(" "), (F.col("ordinal") % 7).cast("string"))
    return a.texts(spark, sf_dir).withColumn("canonical_label", label).withColumn("theme", F.lit("Tech"))


_TEXT_STORIES = f"""{a.TEXTS},
text_stories AS (
  SELECT *, source || ' ' || language || ' ' || (ordinal % 7) AS canonical_label, 'Tech' AS theme FROM texts
)"""


@query(f"""
WITH {_TEXT_STORIES}, {_sql_scores("text_stories", TEXT_PLACES)}, {_sql_locations("text_stories")}
SELECT canonical_label, scope, label, confidence, CAST(points AS BIGINT) AS points, spots FROM located
""")
def text_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of stories made of whole documents."""
    return _location_rows(story_locations(_text_stories(spark, sf_dir), TEXT_PLACES))


def _location_rows(located: DataFrame) -> DataFrame:
    """Locations with their points as text."""
    spot = lambda p: F.concat_ws(
        " ", p["label"], p["lat"].cast("decimal(9,4)").cast("string"), p["lon"].cast("decimal(9,4)").cast("string")
    )
    return located.select(
        "canonical_label", "location.scope", "location.label", "location.confidence",
        F.size("location.points").cast("bigint").alias("points"),
        F.array_join(F.transform("location.points", spot), "; ").alias("spots"),
    )


_PASSAGE_WORDS = 4


@query(f"""
WITH {a.TEXTS},
text_stories AS (SELECT *, source || ' ' || language AS canonical_label FROM texts),
passages AS (
  SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS words FROM benchmark
),
aliases AS (
  SELECT item_id AS place_rank, 'item ' || item_id AS place, CAST(item_id AS DOUBLE) AS lat, 0.5::DOUBLE AS lon,
         'local' AS scope, array_to_string(string_split(words, ' ')[:{_PASSAGE_WORDS}], ' ') AS alias,
         '(^|[^a-z0-9])' || regexp_escape(array_to_string(string_split(words, ' ')[:{_PASSAGE_WORDS}], ' ')) || '([^a-z0-9]|$)' AS pattern
  FROM passages
), {_sql_found("text_stories")}
SELECT canonical_label, place_rank, label, lat, score FROM scores
""")
def gazetteer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a gazetteer that is a table: the first words of every benchmark item."""
    words = F.split(fold("text"), " ")
    item = F.col("item_id")
    gazetteer = a.table(spark, sf_dir, "benchmark").select(
        item.alias("place_rank"),
        F.concat(F.lit("item "), item.cast("string")).alias("label"),
        item.cast("double").alias("lat"),
        F.lit(0.5).alias("lon"),
        F.lit("local").alias("scope"),
        F.array_join(F.slice(words, 1, _PASSAGE_WORDS), " ").alias("alias"),
    )
    label = F.concat("source", F.lit(" "), "language")
    rows = score_places(a.texts(spark, sf_dir).withColumn("canonical_label", label), gazetteer)
    return rows.select("canonical_label", "place_rank", "label", "lat", "score")


@query(f"""
WITH {a.ART}, {_sql_scores("art", GAZETTEER)}, {_sql_locations("art")}
SELECT canonical_label, scope, label, confidence, CAST(points AS BIGINT) AS points, spots FROM located
""")
def story_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location of every story of the events."""
    return _location_rows(story_locations(a.articles(spark, sf_dir)))


@query(f"""
WITH {FILLED}, {_sql_scores("art", GAZETTEER)}, {_sql_locations("art")},
latest AS (
  SELECT *, coalesce(strftime(latest_reported, '%Y-%m-%d %H:%M UTC'), first_published_at, 'unknown time') AS at_time,
         CASE WHEN source_count <> 1 THEN 'sources' ELSE 'source' END AS word
  FROM filled
),
counts AS (SELECT canonical_label, source, count(*) AS n, min(ordinal) AS first FROM art GROUP BY ALL),
listed AS (SELECT canonical_label, string_agg(source, ', ' ORDER BY n DESC, first) AS names
           FROM counts GROUP BY canonical_label)
SELECT f.canonical_label,
       CASE f.trend WHEN 'new' THEN 'FIRST REPORT' WHEN 'up' THEN 'DEVELOPING' WHEN 'down' THEN 'COOLING'
                    ELSE 'CONTINUING STORY' END AS tag,
       l.label || ' | ' || {_SUMMARY} || ' | importance ' || {_IMPORTANCE} || ' | ' || source_count || ' '
         || word || ' | latest ' || at_time AS meta,
       'What changed today: ' || delta || chr(10) || chr(10)
         || CASE WHEN f.trend <> 'new' AND context_summary IS NOT NULL
                 THEN 'Previously: ' || substring(context_summary, 13, strpos(context_summary, '.') - 12)
                      || chr(10) || chr(10) ELSE '' END
         || briefing AS body,
       'Sources: ' || s.names AS sources
FROM latest f JOIN located l USING (canonical_label) JOIN listed s USING (canonical_label)
""")
def edition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the edition: tag, meta line, body and sources of displayed stories."""
    rows = rows_of_edition(_filled(spark, sf_dir), a.tracked(spark, sf_dir))
    return rows.select("canonical_label", "tag", "meta", "body", "sources")


@query(f"""
WITH {SECTIONS}
SELECT canonical_label, 0 AS part, article_count AS articles,
       sha256('{{"canonical_label":"' || canonical_label || '","articles":['
              || (SELECT string_agg('{{"source":"' || source || '","title":"' || title || '","description":"'
                    || description || '","reported_at":"' || published_at || '","url":"'
                    || url || '"}}', ',' ORDER BY ordinal)
                  FROM tracked t WHERE t.canonical_label = shown.canonical_label) || ']'
              || coalesce(',"previous_context":{{"summary":"' || context_summary || '"}}', '') || '}}') AS request_hash
FROM shown
""")
def request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefing requests of the displayed stories."""
    rows = brief.briefing_requests(a.tracked(spark, sf_dir), cut(_sections(spark, sf_dir)))
    return rows.select(
        "canonical_label", F.col("part").cast("int").alias("part"),
        F.col("articles").cast("bigint").alias("articles"), F.sha2("request", 256).alias("request_hash"),
    )


@query("""
WITH last AS (
  SELECT doc_id % 40 AS k, doc_id % 3 AS part, max(doc_id) AS d FROM documents GROUP BY ALL
)
SELECT 'Story ' || k AS canonical_label,
       string_agg('text ' || d, chr(10) || chr(10) ORDER BY part) AS briefing,
       coalesce(string_agg(CASE WHEN d % 2 = 0 THEN 'change ' || d END, chr(10) || chr(10) ORDER BY part), '')
         AS delta_summary
FROM last GROUP BY k
""")
def briefing_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to the parts of a story's request, the last of each part, in part order."""
    doc = F.col("doc_id")
    item = F.struct(
        F.concat(F.lit("Story "), doc % 40).alias("canonical_label"),
        F.when(doc % 3 > 0, doc % 3).alias("part"),
        F.concat(F.lit(" text "), doc).alias("briefing"),
        F.when(doc % 2 == 0, F.concat(F.lit("change "), doc)).otherwise(" ").alias("delta_summary"),
    )
    replies = a.table(spark, sf_dir, "documents").select(
        doc.alias("reply_no"),
        F.lit(None).cast("string").alias("article_id"),
        F.to_json(F.struct(F.array(item).alias("briefings"))).alias("reply"),
    )
    return read_briefings(replies)
