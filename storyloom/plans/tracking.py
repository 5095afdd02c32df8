"""Labeled articles -> continuing stories."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.constants import LOOKBACK_DAYS
from storyloom.functions.dates import parse_reported
from storyloom.functions.labels import may_be_same_story
from storyloom.functions.stories import trend
from storyloom.operators.coverage import (
    prior_articles,
    prior_observation,
    recent_stories,
    story_bounds,
)
from storyloom.operators.merging import merge_labels
from storyloom.operators.ranking import number_rows, positions
from storyloom.operators.story_days import (
    PRIOR,
    carry_on,
    day_rows,
    follow_back,
    labels_alive,
    latest_before,
    recent_labels,
    remember,
)
from storyloom.operators.tables import last_write_per_key, write_memory
from storyloom.schemas import PREVIOUS_CONTEXT
from storyloom.session import cut
from storyloom.sources.state import StateStore

_NO_GROUPS = "group_pos bigint, canonical_label string, labels array<string>"
_NO_MATCHES = "today_label string, canonical_label string"


@dataclass
class History:
    """What earlier days left, from the tables themselves."""

    stories: DataFrame
    daily: DataFrame
    observations: DataFrame
    articles: DataFrame

    def recent(self, today: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
        return recent_stories(self.stories, self.daily, F.lit(today).cast("date"), lookback_days)

    def same_label(self, today: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
        return stories_by_label(self.stories, self.daily, F.lit(today).cast("date"), lookback_days)

    def prior(self, ids: DataFrame, today: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
        """(story_id, *PRIOR) of the given stories before ``today``."""
        day = F.lit(today).cast("date")
        daily = self.daily.join(ids, "story_id", "left_semi").filter(F.col("date") < day)
        counted = daily.groupBy("story_id").agg(
            F.max("date").alias("previous_date"),
            F.max_by("source_count", "date").alias("previous_count"),
            F.min("date").alias("first_seen"),
        )
        observed = prior_observation(self.observations.join(ids, "story_id", "left_semi"), day)
        earlier = self.articles.withColumnRenamed("published_at", "reported_at").withColumn(
            "description", F.coalesce("description", F.lit(""))
        ).withColumn("reported_at", F.coalesce("reported_at", F.lit("")))
        articles = prior_articles(earlier.join(ids, "story_id", "left_semi"), day)
        return counted.join(observed, "story_id", "full").join(articles, "story_id", "full").select(
            "story_id", *PRIOR
        )

    def last_id(self) -> int:
        """The largest id given so far; one value."""
        return self.stories.agg(F.max("story_id")).first()[0] or 0


@dataclass
class StoryDays:
    """What earlier days left, from the rows kept per story and day."""

    store: StateStore

    def _since(self, today: str, lookback_days: int) -> str:
        return (date.fromisoformat(today) - timedelta(days=lookback_days)).isoformat()

    def recent(self, today: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
        return recent_labels(self.store.read("story_days", self._since(today, lookback_days), today))

    def same_label(self, today: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
        days = self.store.read("story_days", self._since(today, lookback_days))
        return labels_alive(days, F.lit(today).cast("date"))

    def prior(self, ids: DataFrame, today: str, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
        """(story_id, *PRIOR) of stories that were alive around ``today``.

        Such a story has a day in the window, or days after ``today`` that lead back.
        """
        since = self._since(today, lookback_days)
        found = latest_before(self.store.read("story_days", since, today), ids)
        if not any(d >= today for d in self.store.dates("story_days")):
            return found
        rest = ids.join(found.select("story_id"), "story_id", "left_anti")
        later = self.store.read("story_days", since=today)
        return found.unionByName(follow_back(later, self.store.read("story_days", before=since), rest))

    def last_id(self) -> int:
        return self.store.counter("story_id")


@dataclass
class Tracked:
    """Tracked articles and the state rows of the day."""

    articles: DataFrame
    stories: DataFrame
    new_stories: DataFrame
    state: dict[str, DataFrame]

    def contexts(self) -> DataFrame:
        """(canonical_label, previous_context), from the first group that has one."""
        known = F.when(F.col("previous_context").isNotNull(), F.col("group_order"))
        return self.stories.groupBy("canonical_label").agg(
            F.min_by("previous_context", known).alias("previous_context")
        )


def observation_id(story_id: Column | str, date: Column) -> Column:
    """One id per story and day, increasing with both."""
    return F.col(story_id) * 100_000 + F.datediff(date, F.lit("1970-01-01").cast("date"))


def match_groups(groups: DataFrame, matches: DataFrame, recent: DataFrame) -> DataFrame:
    """Add the recent story a group was matched to; null where the group is new.

    A proposed match counts when the proposed label is a recent one and the guard
    lets the two labels meet.
    """
    proposed = matches.select(
        F.col("today_label").alias("group_label"), F.col("canonical_label").alias("_proposed")
    )
    known = recent.select(
        F.col("canonical_label").alias("_proposed"), F.col("story_id").alias("_recent_id")
    )
    joined = groups.join(proposed, "group_label", "left").join(known, "_proposed", "left")
    holds = F.col("_recent_id").isNotNull() & may_be_same_story("group_label", "_proposed")
    return joined.select(
        *groups.columns,
        F.when(holds, F.col("_proposed")).alias("matched_label"),
        F.when(holds, F.col("_recent_id")).alias("matched_id"),
    )


def stories_by_label(
    stories: DataFrame, daily: DataFrame, today: Column, lookback_days: int = LOOKBACK_DAYS
) -> DataFrame:
    """Newest story per exact label that was alive around ``today``."""
    alive = story_bounds(daily).filter(
        (F.col("last_seen") >= F.date_sub(today, lookback_days)) & (F.col("first_seen") <= today)
    )
    newest = F.max_by("story_id", F.struct("last_seen", "story_id"))
    return stories.join(alive, "story_id").groupBy("canonical_label").agg(newest.alias("label_id"))


def previous_context() -> Column:
    """Memory and latest articles before the day, null where there are none."""
    context = F.struct(
        F.col("memory.last_observed").alias("last_observed"),
        F.col("memory.summary").alias("summary"),
        F.col("memory.delta_summary").alias("delta_summary"),
        "recent_articles",
    ).cast(PREVIOUS_CONTEXT)
    return F.when(F.col("memory").isNotNull() | F.col("recent_articles").isNotNull(), context)


def track(
    labeled: DataFrame,
    history: History | StoryDays,
    today: str,
    groups: DataFrame | None = None,
    matches: DataFrame | None = None,
    lookback_days: int = LOOKBACK_DAYS,
) -> Tracked:
    """Attach each article to a story and compute the state rows of ``today``.

    ``groups`` are proposals to merge today's labels, ``matches`` proposals to
    continue recent stories. The tracked articles are numbered in tracking order
    (``ordinal``): group by group, label by label, then by arrival. Everything about earlier days is read as of before
    ``today``, so any date can be rebuilt.
    """
    spark = labeled.sparkSession
    day = F.lit(today).cast("date")
    groups = spark.createDataFrame([], _NO_GROUPS) if groups is None else groups
    matches = spark.createDataFrame([], _NO_MATCHES) if matches is None else matches

    labels = labeled.groupBy("story_label").agg(F.min("ordinal").alias("first_ordinal"))
    # One label alone is not grouped.
    groups = groups.where(labels.agg(F.count("*") > 1).scalar())
    placements = cut(merge_labels(labels, groups))

    # From here on one number gives the order of the articles, in every report.
    placed = labeled.join(placements, "story_label")
    placed = number_rows(placed, [F.col("label_order"), F.col("ordinal")], "_place")
    placed = placed.drop("label_order", "ordinal").withColumnRenamed("_place", "ordinal")
    metrics = placed.groupBy("group_label").agg(
        F.count_distinct("source").alias("source_count"),
        F.count("*").alias("article_count"),
        F.avg("importance").alias("importance_avg"),
        F.min("ordinal").alias("group_order"),
        F.min_by("theme", "ordinal").alias("theme"),
    )
    matched = match_groups(metrics, matches, history.recent(today, lookback_days))
    same_label = history.same_label(today, lookback_days)
    resolved = (
        matched.join(same_label, matched["group_label"] == same_label["canonical_label"], "left")
        .withColumn("known_id", F.coalesce("matched_id", "label_id"))
        .withColumn("canonical_label", F.coalesce("matched_label", "group_label"))
        .drop("matched_id", "label_id", "matched_label")
    )
    resolved = cut(resolved)

    # Ids of removed stories are not reused.
    high_water = history.last_id()
    new = number_rows(resolved.filter(F.col("known_id").isNull()), [F.col("group_order")])
    new = new.withColumn("story_id", F.col("position") + high_water).drop("position")
    known = resolved.filter(F.col("known_id").isNotNull()).withColumn(
        "story_id", F.col("known_id")
    )
    assigned = known.unionByName(new).withColumn("is_new", F.col("known_id").isNull())
    assigned = assigned.drop("known_id")

    ids = assigned.select("story_id").distinct()
    stories = cut(
        assigned.join(history.prior(ids, today, lookback_days), "story_id", "left")
        .withColumn("previous_context", previous_context())
        .withColumn("trend", trend("source_count", "previous_count"))
        .withColumn("observation_id", observation_id("story_id", day))
    )

    carried = ["group_label", "story_id", "observation_id", "canonical_label", "trend",
               "previous_context"]
    tracked = placed.join(stories.select(*carried), "group_label").withColumn(
        "reported_ts", parse_reported("published_at")
    )
    return Tracked(
        articles=tracked,
        stories=stories,
        new_stories=stories.filter("is_new").select(
            "story_id", F.col("group_label").alias("canonical_label"), "theme", day.alias("created")
        ),
        state=_state_rows(tracked, stories, day),
    )


def _state_rows(tracked: DataFrame, stories: DataFrame, day: Column) -> dict[str, DataFrame]:
    """State rows of the day; of several groups on one story the last one is kept."""
    last = last_write_per_key(stories, ["story_id"], F.col("group_order"))
    observations = last.select(
        "observation_id",
        "story_id",
        day.alias("date"),
        F.col("group_label").alias("label_seen"),
        "source_count",
        "article_count",
        "importance_avg",
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("delta_summary"),
        F.lit(None).cast("double").alias("novelty_score"),
    )
    daily = last.select(
        "story_id",
        day.alias("date"),
        "source_count",
        "importance_avg",
        F.to_json(F.array("group_label")).alias("labels_seen"),
    )
    written = tracked.join(last.select("group_label"), "group_label", "left_semi")
    articles = written.select(
        F.col("id").cast("string").alias("id"), "story_id", day.alias("date"), "source", "title",
        "description", "url", "published_at", "importance",
    )
    links = written.select(
        F.col("id").cast("string").alias("article_id"), "story_id", "observation_id",
        F.lit(1.0).alias("relevance"), day.alias("date"),
    ).distinct()
    return {
        "articles": articles,
        "story_observations": observations,
        "article_story_links": links,
        "story_daily": daily,
        "story_days": day_rows(last, articles, day),
    }


def save_tracking(store: StateStore, tracked: Tracked, today: str) -> None:
    """Rebuild the date in every table, all in one transaction.

    A batch without articles leaves the state as it is: an empty or unreadable landing must
    not undo a day that was stored before.
    """
    if tracked.stories.isEmpty():
        return
    with store.transaction():
        if not tracked.new_stories.isEmpty():
            store.append("stories", tracked.new_stories)
            store.set_counter("story_id", tracked.new_stories.agg(F.max("story_id")).first()[0])
        for name in ("articles", "story_observations", "article_story_links", "story_daily"):
            store.replace_date(name, tracked.state[name], today)
        replace_story_days(store, tracked.state["story_days"], today)


def replace_story_days(store: StateStore, rows: DataFrame, today: str) -> None:
    """Rebuild a date's rows, and what later days carry on from them."""
    tomorrow = (date.fromisoformat(today) + timedelta(days=1)).isoformat()
    with store.transaction():
        before = store.read("story_days", today, tomorrow)
        rows = cut(rows)
        store.replace_date("story_days", rows, today)
        if not any(d > today for d in store.dates("story_days")):
            return
        # Stories that lost this day carry on from the day before it.
        gone = before.join(rows.select("story_id"), "story_id", "left_anti")
        lost = gone.select("story_id", F.col("previous_date").alias("date"))
        seeds = rows.unionByName(
            store.read("story_days", before=today).join(lost, ["story_id", "date"], "left_semi")
        )
        moved = rows.select("story_id").unionByName(gone.select("story_id")).distinct()
        later = store.read("story_days", since=tomorrow)
        changed = carry_on(seeds, later.join(moved, "story_id", "left_semi"))
        kept = later.join(moved, "story_id", "left_anti")
        store.replace_dates("story_days", cut(kept.unionByName(changed)))


def save_texts(store: StateStore, memories: DataFrame, today: str) -> None:
    """Write the texts of a report (observation_id, summary, delta_summary) back to the day."""
    tomorrow = (date.fromisoformat(today) + timedelta(days=1)).isoformat()
    written = cut(write_memory(store.read("story_observations", today, tomorrow), memories))
    with store.transaction():
        store.replace_date("story_observations", written, today)
        replace_story_days(store, remember(store.read("story_days", today, tomorrow), written), today)


def load_history(store: StateStore) -> StoryDays:
    return StoryDays(store)


def whole_history(store: StateStore) -> History:
    """All tables; for checks against the rows kept per story and day."""
    return History(
        store.read("stories"),
        store.read("story_daily"),
        store.read("story_observations"),
        store.read("articles"),
    )


def tracking_counters(stories: DataFrame) -> DataFrame:
    """One row of a run: labels of the day, stories they went to, and new ones among them."""
    return stories.agg(
        F.count("*").alias("labels"),
        F.count_distinct("story_id").alias("stories"),
        F.count_if("is_new").alias("new_stories"),
    )


def match_requests(labels: DataFrame, recent: DataFrame, part_size: int = 5000) -> DataFrame:
    """(kind, part, request): today's labels, and those of recent stories to match them with."""
    known = recent.select(F.col("canonical_label").alias("story_label")).distinct()
    numbered = number_rows(known, [F.col("story_label")]).select(
        "story_label", F.col("position").cast("bigint").alias("first_ordinal")
    )
    return (
        label_requests(labels, part_size)
        .withColumn("kind", F.lit("today"))
        .unionByName(label_requests(numbered, part_size).withColumn("kind", F.lit("recent")))
        .select("kind", "part", "request")
    )


def label_requests(labels: DataFrame, part_size: int = 5000) -> DataFrame:
    """Today's labels as JSON arrays of at most ``part_size``, in order of appearance.

    A reply to one part may name labels of any other part; labels that must be seen
    together need a larger ``part_size``.
    """
    numbered = positions(labels, [], "first_ordinal", name="_position").withColumn(
        "part", F.floor((F.col("_position") - 1) / part_size)
    )
    ordered = F.sort_array(F.collect_list(F.struct("_position", "story_label")))
    return numbered.groupBy("part").agg(
        F.to_json(F.transform(ordered, lambda r: r["story_label"])).alias("request")
    )
