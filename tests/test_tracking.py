import json

import pytest
from helpers import column, labeled, replies
from pyspark.sql import functions as F

from storyloom.functions.labels import may_be_same_story
from storyloom.operators.coverage import count_before, recent_stories
from storyloom.operators.merging import label_clusters, merge_labels
from storyloom.operators.tables import write_memory
from storyloom.plans.tracking import label_requests, load_history, match_groups, save_texts, save_tracking, track
from storyloom.sources.replies import group_replies, match_replies
from storyloom.sources.state import StateStore

STORY = ("Test Story", "Test Source", "Tech", 3)


def _run(spark, store, rows, today, groups=None, matches=None):
    out = track(
        labeled(spark, *rows), load_history(store), today,
        None if groups is None else group_replies(replies(spark, json.dumps({"groups": groups}))),
        None if matches is None else match_replies(replies(spark, json.dumps({"matches": matches}))),
    )
    save_tracking(store, out, today)
    return out


def _counts(store):
    names = ["story_daily", "story_observations", "article_story_links", "articles"]
    return [store.read(n).count() for n in names]


def _visible(store):
    return store.read("stories").join(store.read("story_daily"), "story_id", "left_semi")


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"))


def test_same_day_twice_is_the_same(spark, store):
    rows = [(1, *STORY), (2, *STORY)]
    first = _run(spark, store, rows, "2026-04-18")
    second = _run(spark, store, rows, "2026-04-18")
    assert first.articles.count() == second.articles.count() == 2
    assert _counts(store) == [1, 1, 2, 2]
    assert column(_visible(store), "story_id") == [1]
    assert column(second.stories, "story_id") == [1]


def test_same_day_with_another_label_replaces_the_story(spark, store):
    _run(spark, store, [(1, "Old Story", "S", "Tech", 3)], "2026-04-18")
    _run(spark, store, [(1, "New Story", "S", "Tech", 3)], "2026-04-18")
    assert column(_visible(store), "canonical_label") == ["New Story"]
    assert _counts(store) == [1, 1, 1, 1]
    # Ids are not handed out twice.
    assert column(_visible(store), "story_id") == [2]


def test_rebuilding_a_date_leaves_other_dates(spark, store):
    _run(spark, store, [(1, *STORY)], "2026-04-17")
    _run(spark, store, [(2, *STORY)], "2026-04-18")
    _run(spark, store, [(3, "Other Story", "S", "Tech", 3)], "2026-04-17")
    daily = store.read("story_daily").orderBy("date").collect()
    labels = {r["story_id"]: r["canonical_label"] for r in store.read("stories").collect()}
    assert [(str(r["date"]), labels[r["story_id"]]) for r in daily] == [
        ("2026-04-17", "Other Story"), ("2026-04-18", "Test Story"),
    ]


def test_context_of_a_continued_story(spark, store):
    first = _run(spark, store, [(1, *STORY)], "2026-04-18")
    memory = first.stories.select(
        "observation_id", F.lit(" Earlier summary. ").alias("summary"),
        F.lit("Earlier change.").alias("delta_summary"),
    )
    save_texts(store, memory, "2026-04-18")
    second = _run(
        spark, store, [(2, *STORY)], "2026-04-19",
        matches=[{"today_label": "Test Story", "canonical_label": "Test Story"}],
    )
    row = second.articles.first()
    context = row["previous_context"]
    assert (str(context["last_observed"]), context["summary"], context["delta_summary"]) == (
        "2026-04-18", "Earlier summary.", "Earlier change.",
    )
    assert [a["title"] for a in context["recent_articles"]] == ["Title 1"]
    assert context["recent_articles"][0]["description"] == "Description"
    assert (row["story_id"], row["trend"]) == (1, "steady")


def test_matched_story_keeps_its_label(spark, store):
    _run(spark, store, [(1, "Train Collision", "S", "Tech", 3)], "2026-04-18")
    out = _run(
        spark, store,
        [(2, "Train Crash", "S", "Tech", 3), (3, "Molen Accident", "S", "Tech", 3)],
        "2026-04-19",
        matches=[
            {"today_label": "Train Crash", "canonical_label": "Train Collision"},
            {"today_label": "Molen Accident", "canonical_label": "Train Collision"},
        ],
    )
    got = {r["id"]: (r["canonical_label"], r["story_id"], r["trend"]) for r in out.articles.collect()}
    assert got == {"2": ("Train Collision", 1, "steady"), "3": ("Molen Accident", 2, "new")}


def test_two_groups_on_one_story_keep_the_last_in_state(spark, store):
    _run(spark, store, [(1, "Budget Vote", "S", "Economy", 3)], "2026-04-18")
    out = _run(
        spark, store,
        [(2, "Budget Vote", "S", "Economy", 3), (3, "Budget Debate", "T", "Economy", 5)],
        "2026-04-19",
        matches=[{"today_label": "Budget Debate", "canonical_label": "Budget Vote"}],
    )
    assert sorted(column(out.articles, "id")) == ["2", "3"]
    assert set(column(out.articles, "story_id")) == {1}
    today = store.read("articles").filter("date = '2026-04-19'")
    assert column(today, "id") == ["3"]
    daily = store.read("story_daily").filter("date = '2026-04-19'").first()
    assert (daily["importance_avg"], json.loads(daily["labels_seen"])) == (5.0, ["Budget Debate"])


def test_unrelated_generic_labels_are_not_merged(spark, store):
    rows = [(1, "Molen Accident", "S", "Tech", 3), (2, "E-Motorcycle Manslaughter", "S", "Tech", 3)]
    out = _run(
        spark, store, rows, "2026-04-18",
        groups=[{"canonical_label": "Fair Ride Accident", "labels": [r[1] for r in rows]}],
    )
    assert {r["id"]: r["canonical_label"] for r in out.articles.collect()} == {
        "1": "Molen Accident", "2": "E-Motorcycle Manslaughter",
    }


def test_labels_with_a_common_word_are_merged(spark, store):
    rows = [(1, "Train Crash", "S", "Tech", 3), (2, "Train Collision", "T", "Economy", 4)]
    out = _run(
        spark, store, rows, "2026-04-18",
        groups=[{"canonical_label": "Train Collision", "labels": ["Train Crash", "Train Collision"]}],
    )
    story = out.stories.collect()
    assert [(s["group_label"], s["source_count"], s["theme"]) for s in story] == [
        ("Train Collision", 2, "Tech")
    ]


def test_proposals_are_ignored_for_a_single_label(spark, store):
    out = _run(
        spark, store, [(1, *STORY)], "2026-04-18",
        groups=[{"canonical_label": "Renamed", "labels": ["Test Story"]}],
    )
    assert column(out.stories, "group_label") == ["Test Story"]


def test_a_label_proposed_twice_counts_twice(spark):
    labels = spark.createDataFrame([("A one", 0), ("B two", 1)], "story_label string, first_ordinal bigint")
    groups = [
        {"canonical_label": "X", "labels": ["A one", "missing", 5]},
        {"canonical_label": "Y", "labels": ["A one"]},
        {"canonical_label": "", "labels": ["B two"]},
        "no object",
        {"canonical_label": "Z", "labels": "B two"},
    ]
    proposals = group_replies(replies(spark, json.dumps({"groups": groups})))
    got = merge_labels(labels, proposals).orderBy("label_order").collect()
    assert [(r["story_label"], r["group_label"]) for r in got] == [
        ("A one", "X"), ("A one", "Y"), ("B two", "B two"),
    ]


def test_match_replies_last_wins_and_unknown_labels_are_new(spark):
    matches = match_replies(
        replies(spark, json.dumps({"matches": [
            {"today_label": "Molen Accident", "canonical_label": "Fair Ride Accident"},
            {"today_label": "Train Crash", "canonical_label": "NEW"},
            {"today_label": "Train Crash", "canonical_label": "Train Collision"},
            {"today_label": 4, "canonical_label": "Train Collision"},
        ]}))
    )
    groups = spark.createDataFrame([("Molen Accident",), ("Train Crash",), ("Else",)], "group_label string")
    recent = spark.createDataFrame(
        [("Fair Ride Accident", 1), ("Train Collision", 2)], "canonical_label string, story_id bigint"
    )
    got = {r["group_label"]: r["matched_id"] for r in match_groups(groups, matches, recent).collect()}
    assert got == {"Molen Accident": None, "Train Crash": 2, "Else": None}


def _daily(spark, *rows):
    df = spark.createDataFrame(rows, "story_id bigint, date string, source_count bigint")
    return df.withColumn("date", F.col("date").cast("date"))


def test_trend_is_against_the_latest_earlier_day(spark):
    daily = _daily(spark, (1, "2026-04-16", 1), (1, "2026-04-17", 4), (1, "2026-04-18", 9))
    today = F.lit("2026-04-18").cast("date")
    assert column(count_before(daily, today), "previous_count") == [4]


def test_recent_stories_take_the_newest_of_a_label(spark):
    stories = spark.createDataFrame(
        [(1, "Duplicate"), (2, "Duplicate"), (3, "Long ago")], "story_id bigint, canonical_label string"
    )
    daily = _daily(spark, (1, "2026-04-18", 1), (2, "2026-04-20", 1), (3, "2026-04-06", 1))
    today = F.lit("2026-04-21").cast("date")
    assert column(recent_stories(stories, daily, today), "story_id") == [2]
    assert sorted(column(recent_stories(stories, daily, today, 15), "story_id")) == [2, 3]


@pytest.mark.parametrize(
    "left, right, allowed",
    [
        ("Molen Accident", "E-Motorcycle Manslaughter", False),
        ("Molen Accident", "Windmill Incident", True),
        ("Train Crash", "train crash ", True),
        ("Shooting", " shooting", True),
        ("Shooting", "Stabbing", False),
        ("Budget Vote", "Stabbing", True),
        ("OpenAI Lawsuit", "OpenAI Shooter Lawsuit", True),
    ],
)
def test_guard(spark, left, right, allowed):
    row = spark.range(1).select(may_be_same_story(F.lit(left), F.lit(right)).alias("ok")).first()
    assert row["ok"] is allowed


def _brute_force(labels, events):
    """First fit by definition, for labels of words."""
    def fits(a, b):
        both = set(a.split()) & events and set(b.split()) & events
        return a == b or not both or bool((set(a.split()) & set(b.split())) - events)

    clusters = []
    for text in labels:
        for cluster in clusters:
            if all(fits(text, other) for other in cluster):
                cluster.append(text)
                break
        else:
            clusters.append([text])
    return {text: i for i, cluster in enumerate(clusters) for text in cluster}


def test_first_fit_against_brute_force(spark):
    import random

    rng = random.Random(7)
    events = ["crash", "fire", "trial"]
    rows, want = [], {}
    for group in range(40):
        labels = list(dict.fromkeys(
            " ".join(rng.sample(["red", "blue", "old", "new", "port", "city", *events], rng.randint(1, 4)))
            for _ in range(14)
        ))
        rows += [(group, pos, text) for pos, text in enumerate(labels)]
        want.update({(group, t): c for t, c in _brute_force(labels, set(events)).items()})
    members = spark.createDataFrame(rows, "group_pos bigint, label_pos bigint, label string")
    for partitions in (1, 5):
        got = label_clusters(members.repartition(partitions), generic=events, stopwords=[])
        assert {(r["group_pos"], r["label"]): r["cluster"] for r in got.collect()} == want


def test_label_requests_are_split(spark):
    labels = spark.createDataFrame([(f"L{i}", i * 7) for i in range(5)], "story_label string, first_ordinal bigint")
    got = label_requests(labels, 3).orderBy("part").collect()
    assert [json.loads(r["request"]) for r in got] == [["L0", "L1", "L2"], ["L3", "L4"]]
