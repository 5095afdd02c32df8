import json

from helpers import items, replies
from pyspark.sql import functions as F

from storyloom.plans.ingest import ingest
from storyloom.plans.labels import label, label_requests
from storyloom.schemas import STATE_TABLES
from storyloom.sources.replies import label_replies, reply_rejects
from storyloom.sources.state import StateStore

NOON = "Sat, 18 Apr 2026 12:00:00 GMT"


def _articles(spark, description="Markets move higher."):
    rows = ingest(items(spark, ("Example", "Stocks rise", "https://example.com/stocks", NOON))).articles
    return rows.withColumn("id", F.lit("article-1")).withColumn("description", F.lit(description))


def _reply(**fields):
    return json.dumps({"results": [{"id": "article-1", **fields}]})


GOOD = _reply(theme="Economy", story_label="Market Rally", importance=4)


def _empty_cache(spark):
    return spark.createDataFrame([], STATE_TABLES["article_labels"][0])


def _one(df):
    return tuple(df.select("theme", "story_label", "importance").first())


def test_reply_is_stored_and_used_again(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    first = label(_articles(spark), store.read("article_labels"), replies(spark, GOOD))
    assert _one(first.labeled) == ("Economy", "Market Rally", 4)
    store.replace_keys("article_labels", first.new_cache_rows)

    second = label(_articles(spark), store.read("article_labels"), replies(spark))
    assert _one(second.labeled) == ("Economy", "Market Rally", 4)
    assert second.misses.count() == 0

    changed = label(
        _articles(spark, "Markets fall sharply."),
        store.read("article_labels"),
        replies(spark, _reply(theme="Economy", story_label="Story 2", importance=3)),
    )
    assert changed.misses.count() == 1
    assert _one(changed.labeled) == ("Economy", "Story 2", 3)
    store.replace_keys("article_labels", changed.new_cache_rows)
    assert [r["story_label"] for r in store.read("article_labels").collect()] == ["Story 2"]


def test_a_newer_model_does_not_see_older_labels(spark):
    first = label(_articles(spark), _empty_cache(spark), replies(spark, GOOD))
    later = label(_articles(spark), first.new_cache_rows, replies(spark), model="other")
    assert _one(later.labeled) == ("Other", "Uncategorized", 1)
    assert later.new_cache_rows.count() == 0


def test_empty_batch(spark):
    out = label(_articles(spark).limit(0), _empty_cache(spark), replies(spark))
    assert out.labeled.count() == 0


def test_unusable_replies_are_set_aside(spark):
    rows = replies(spark, "[]", "{", '{"results": {}}', '{"other": []}', GOOD)
    got = {r["reply_no"]: r["reject_reason"] for r in reply_rejects(rows, "results").collect()}
    assert got == {0: "not_an_object", 1: "invalid_json", 2: "missing_list", 3: "missing_list"}


def test_field_rules_and_last_answer(spark):
    elements = [
        {"id": "a", "theme": "Economy", "story_label": "x", "importance": 2},
        "text", 7, None, ["a"],
        {"id": "a", "theme": "Weather", "story_label": "  ", "importance": 4.9},
        {"id": 5, "theme": "Tech", "story_label": " y ", "importance": " +3 "},
        {"id": "b", "theme": None, "importance": "4.5"},
        {"id": "c", "theme": 3, "story_label": 0, "importance": 99},
        {"id": "d", "story_label": 12, "importance": -1},
        {"id": "e", "importance": None, "story_label": False},
        {"id": "f", "importance": True, "story_label": True},
    ]
    rows = label_replies(replies(spark, json.dumps({"results": elements}))).collect()
    assert {r["article_id"]: (r["theme"], r["story_label"], r["importance"]) for r in rows} == {
        "a": ("Other", "Uncategorized", 4),
        "5": ("Tech", "y", 3),
        "b": ("Other", "Uncategorized", 1),
        "c": ("Other", "Uncategorized", 5),
        "d": ("Other", "12", 1),
        "e": ("Other", "Uncategorized", 1),
        "f": ("Other", "true", 1),
    }


def test_requests_are_batches_in_arrival_order(spark):
    rows = ingest(
        items(spark, *[("A", f"T{i}", f"https://example.com/{i}", NOON) for i in range(5)])
    ).articles
    got = label_requests(rows, 2).orderBy("batch").collect()
    assert [r["items"] for r in got] == [2, 2, 1]
    assert [e["title"] for r in got for e in json.loads(r["request"])] == [f"T{i}" for i in range(5)]
