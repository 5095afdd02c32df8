"""What the run queries read, and how often."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom.functions.dates import parse_reported
from storyloom.operators.coverage import recent_stories, recent_stories_history
from storyloom.plans import daily
from storyloom.queries import runs

SMALL = "/root/testdata/sf0.001"


def _inputs_of(monkeypatch, module, name):
    """Files behind the rows that a function is called with."""
    seen, real = [], getattr(module, name)

    def watched(rows, *args, **kwargs):
        seen.extend(rows.inputFiles())
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(module, name, watched)
    return seen


@pytest.mark.parametrize(
    "query, module, step",
    [("snapshot_rows", runs, "write_daily_snapshot"), ("stored_day", daily, "label")],
)
def test_items_are_read_for_the_day_once(spark, monkeypatch, query, module, step):
    seen = _inputs_of(monkeypatch, module, step)
    assert getattr(runs, query)(spark, SMALL).count()
    assert seen and not any("events.parquet" in f for f in seen)


def test_usual_dates_are_read_as_others_are(spark):
    rows = [
        ("Tue, 02 Jan 2024 10:20:30 GMT", "2024-01-02 10:20:30"),
        ("Tue, 2 Jan 2024 10:20:30 GMT", "2024-01-02 10:20:30"),
        ("  Tue, 02 Jan 2024 23:20:30 -0230 ", "2024-01-03 01:50:30"),
        ("Tue, 30 Feb 2024 10:20:30 GMT", None),
        ("Tue, 02 Jxn 2024 10:20:30 GMT", None),
        ("Tue, 02 Jan 2024 25:20:30 +0000", None),
    ]
    found = spark.createDataFrame(rows, "raw string, want string")
    got = found.select("want", parse_reported("raw").cast("string").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_recent_stories_come_from_one_row_a_label_and_day(spark):
    start = date(2024, 1, 1)
    labels = {1: "a", 2: "a", 3: "b", 4: "a", 5: None}
    days = [(s, start + timedelta(days=(s * s * k * 7 + 3 * k) % 40)) for s in labels for k in range(5)] + [(9, start), (1, None)]
    stories = spark.createDataFrame(list(labels.items()), "story_id long, canonical_label string")
    rows = spark.createDataFrame(days, "story_id long, date date")
    want = set()
    for n in range(70):
        today, best = start + timedelta(days=n), {}
        for story, day in days:
            if story in labels and day and today - timedelta(days=14) <= day < today:
                best[labels[story]] = max(best.get(labels[story], (day, story)), (day, story))
        want |= {(today, label, story, day) for label, (day, story) in best.items()}
    history = recent_stories_history(stories, rows)
    assert {tuple(r) for r in history.select("today", "canonical_label", "story_id", "last_daily").collect()} == want
    day = start + timedelta(days=20)
    one = recent_stories(stories, rows, F.lit(day)).select("canonical_label", "story_id", "last_daily")
    assert {(day, *r) for r in one.collect()} == {r for r in want if r[0] == day}
    # Sums by hash hold a row a group; a sort holds all that is laid out.
    for found in (history, one):
        assert "SortAggregate" not in found._jdf.queryExecution().toString()
