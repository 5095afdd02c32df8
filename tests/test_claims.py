import json

import pytest
from helpers import column

from storyloom.constants import CLAIM_VERSION
from storyloom.plans.claims import (
    attribute_claims,
    best_claims,
    claim_inputs,
    ground_claims,
    next_claims,
    save_claims,
    story_claims,
)
from storyloom.sources.state import StateStore

ARTICLE = {
    "id": "article-abc123",
    "story_id": 42,
    "source": "Reuters",
    "title": "Iran offers uranium deal",
    "description": "Iran proposed capping enrichment at 3.67%. Officials confirmed the offer.",
    "url": "https://reuters.com/iran",
    "ordinal": 0,
}
SCHEMA = (
    "id string, story_id bigint, source string, title string, description string, url string, "
    "ordinal bigint"
)
SPAN = "Iran proposed capping enrichment at 3.67%."
CLAIMS = [
    {"claim_text": "Iran proposed capping uranium enrichment at 3.67%.", "claim_type": "number",
     "entities": ["Iran"], "evidence_span": SPAN, "confidence": 0.95},
    {"claim_text": "Officials confirmed the offer.", "claim_type": "fact", "entities": [],
     "evidence_span": "officials   CONFIRMED\nthe offer.", "confidence": 0.8},
]


def _article(spark, **changes):
    row = {**ARTICLE, **changes}
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)


def _replies(spark, claims=None, text=None, article="article-abc123"):
    schema = "reply_no bigint, article_id string, reply string"
    if claims is None and text is None:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(0, article, text or json.dumps({"claims": claims}))], schema)


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "state"))


def _run(spark, store, article, replies):
    run = ground_claims(article, store.read("claims"), store.read("claim_extractions"), replies)
    counters = {r["counter"]: r["count"] for r in run.counters().collect()}
    save_claims(store, run)
    return counters


def _saved(store, story=42):
    rows = store.read("claims").filter(f"story_id = {story} and version = '{CLAIM_VERSION}'")
    return best_claims(rows, 100).orderBy("rank").collect()


def test_nothing_tracked(spark, store):
    assert _run(spark, store, _article(spark).limit(0), _replies(spark, CLAIMS)) == {}


def test_claims_are_kept_and_not_read_twice(spark, store):
    assert _run(spark, store, _article(spark), _replies(spark, CLAIMS)) == {"extracted": 1}
    saved = _saved(store)
    assert [(r["claim_type"], list(r["entities"])) for r in saved] == [("number", ["Iran"]), ("fact", [])]
    assert _run(spark, store, _article(spark), _replies(spark, CLAIMS)) == {"cached": 1}
    assert len(_saved(store)) == 2


def test_a_result_without_claims_is_kept_too(spark, store):
    assert _run(spark, store, _article(spark), _replies(spark, [])) == {"extracted": 1}
    assert _run(spark, store, _article(spark), _replies(spark, CLAIMS)) == {"cached": 1}
    assert _saved(store) == []


def test_unsound_claims_are_dropped_with_their_rule(spark):
    sound = {**CLAIMS[0]}
    faults = {
        "not_an_object": "text",
        "empty_text": {**sound, "claim_text": 5},
        "unknown_type": {**sound, "claim_type": "rumor"},
        "bad_entities": {**sound, "entities": "Iran"},
        "bad_entities 2": {**sound, "entities": ["Iran", 1]},
        "bad_entities 3": {**sound, "entities": [" "]},
        "empty_evidence": {**sound, "evidence_span": " "},
        "ungrounded_evidence": {**sound, "evidence_span": "Iran signed a final agreement."},
        "bad_confidence": {**sound, "confidence": "high"},
        "bad_confidence 2": {**sound, "confidence": True},
        "bad_confidence 3": {**sound, "confidence": 1.01},
    }
    nothing = ground_claims(
        _article(spark), *_empty(spark), _replies(spark, [sound, *faults.values()])
    )
    assert column(nothing.claims, "claim_text") == [sound["claim_text"]]
    got = column(nothing.rejected.orderBy("claim_pos"), "reject_reason")
    assert got == [name.split()[0] for name in faults]


def _empty(spark):
    from storyloom.schemas import STATE_TABLES

    return [spark.createDataFrame([], STATE_TABLES[n][0]) for n in ("claims", "claim_extractions")]


def test_an_unusable_reply_is_not_remembered(spark, store):
    bad = _replies(spark, text='{"claims": {"claim_text": "not a list"}}')
    assert _run(spark, store, _article(spark), bad) == {"failed": 1}
    assert _run(spark, store, _article(spark), _replies(spark)) == {"failed": 1}
    assert _saved(store) == []


def test_other_versions_are_left_alone_and_not_shown(spark, store):
    _run(spark, store, _article(spark), _replies(spark, CLAIMS))
    old = store.read("claims").limit(1).selectExpr(
        "'old' AS claim_id", "article_id", "story_id", "'Old cached claim.' AS claim_text", "claim_type",
        "entities", "evidence_span", "0.99 AS confidence", "'old-version' AS version",
    )
    store.replace_keys("claims", old, keys=["claim_id"])
    shown = story_claims(store.read("claims"), _stored(spark))
    assert "Old cached claim." not in column(shown, "claim_text")
    _run(spark, store, _article(spark, description="Other text."), _replies(spark))
    assert column(store.read("claims"), "claim_id") == ["old"]


def _stored(spark, *rows):
    schema = "id string, story_id bigint, date string, source string, title string, url string"
    return spark.createDataFrame(list(rows), schema).selectExpr("*", "cast(date as date) as d").drop(
        "date"
    ).withColumnRenamed("d", "date")


def test_cached_claims_follow_their_story(spark, store):
    _run(spark, store, _article(spark), _replies(spark, CLAIMS))
    assert _run(spark, store, _article(spark, story_id=84), _replies(spark)) == {"cached": 1}
    assert (len(_saved(store)), len(_saved(store, 84))) == (0, 2)
    assert column(store.read("claim_extractions"), "story_id") == [84]


def test_a_changed_text_drops_its_claims_even_without_a_reply(spark, store):
    _run(spark, store, _article(spark), _replies(spark, CLAIMS))
    changed = _article(spark, description="Updated article text.")
    assert _run(spark, store, changed, _replies(spark)) == {"failed": 1}
    assert _saved(store) == []
    assert store.read("claim_extractions").count() == 0


def test_next_claims_equals_the_stored_table(spark, store):
    _run(spark, store, _article(spark), _replies(spark, CLAIMS))
    run = ground_claims(
        _article(spark, story_id=84), store.read("claims"), store.read("claim_extractions"), _replies(spark)
    )
    assert sorted(column(next_claims(store.read("claims"), run), "story_id")) == [84, 84]


def test_inputs_have_no_tags_and_empty_ones_are_left_out(spark):
    html = _article(spark, description="<p>Iran <b>offered</b> a deal.</p>")
    content = claim_inputs(html).first()["content"]
    assert content == "Iran offers uranium deal\n\nIran  offered  a deal."
    assert claim_inputs(_article(spark, title=" \n", description="<br>")).count() == 0


def test_claims_are_described_by_the_latest_day_and_filled_from_today(spark):
    run = ground_claims(_article(spark), *_empty(spark), _replies(spark, CLAIMS))
    stored = _stored(
        spark,
        ("article-abc123", 42, "2026-04-30", "Old", "Old title", "https://old"),
        ("article-abc123", 42, "2026-05-01", "", "New title", None),
        ("article-abc123", 7, "2026-05-02", "Elsewhere", "t", "u"),
    )
    claims = story_claims(run.claims, stored)
    assert [(r["source"], r["article_title"], r["url"]) for r in claims.collect()] == [
        ("", "New title", None)
    ] * 2
    filled = attribute_claims(claims, _article(spark)).first()
    assert (filled["source"], filled["article_title"], filled["url"]) == (
        "Reuters", "New title", "https://reuters.com/iran",
    )
    assert [r["source"] for r in story_claims(run.claims, _stored(spark)).collect()] == [None, None]
