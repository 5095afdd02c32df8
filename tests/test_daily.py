"""The daily job from landed files to reports, on two days."""

import json

import pytest

from storyloom.plans import daily
from storyloom.sources.state import StateStore

DAY_1, DAY_2 = "2026-04-18", "2026-04-19"


def _feed(path, source, *items):
    rows = "".join(
        f"<item><title>{t}</title><link>{u}</link><description>{d}</description><pubDate>{p}</pubDate></item>"
        for t, u, d, p in items
    )
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{source}.xml").write_text(f"<rss><channel>{rows}</channel></rss>")


def _reply(path, kind, payload, article=None):
    (path / kind).mkdir(parents=True, exist_ok=True)
    row = {"reply_no": 0, "article_id": article, "reply": json.dumps(payload)}
    (path / kind / "part.json").write_text(json.dumps(row) + "\n")


def _read(path):
    return "\n".join(p.read_text() for p in sorted(path.glob("part-*")))


def _main(tmp_path, day, *flags):
    daily.main([
        "--today", day, "--feeds", str(tmp_path / f"feeds-{day}"),
        "--replies", str(tmp_path / f"replies-{day}"), "--state", str(tmp_path / "state"),
        "--out", str(tmp_path / f"out-{day}"), *flags,
    ])
    return tmp_path / f"out-{day}"


def test_two_days(spark, tmp_path):
    import hashlib

    url = "https://example.com/mali"
    ident = hashlib.sha256(url.encode()).hexdigest()[:16]
    _feed(
        tmp_path / f"feeds-{DAY_1}", "NOS",
        ("Mali attacks", url + "?utm_source=x", "Troops fled Kati.", "Sat, 18 Apr 2026 10:00:00 GMT"),
        ("Old", "https://example.com/old", "", "Fri, 17 Apr 2026 10:00:00 GMT"),
    )
    answers = tmp_path / f"replies-{DAY_1}"
    _reply(answers, "labels", {"results": [
        {"id": ident, "theme": "Geopolitics & War", "story_label": "Mali Attacks", "importance": 5}]})
    _reply(answers, "claims", {"claims": [
        {"claim_text": "Troops fled.", "claim_type": "fact", "entities": ["Mali"],
         "evidence_span": "troops fled Kati", "confidence": 0.9}]}, ident)
    _reply(answers, "briefings", {"briefings": [
        {"canonical_label": "Mali Attacks", "briefing": "Attacks shook Mali. More follows.",
         "delta_summary": "First wave."}]})
    out = _main(tmp_path, DAY_1, "--show-evidence")

    briefing = _read(next(out.glob("briefing_*")))
    assert "## 1. NEW STORY Mali Attacks" in briefing
    assert "Attacks shook Mali. More follows." in briefing
    assert f'- `fact` — [NOS]({url}?utm_source=x) — "troops fled Kati" _(90%)_' in briefing
    assert "### \U0001f195 Mali Attacks _(importance 5)_" in _read(next(out.glob("digest_*")))
    request = json.loads(spark.read.parquet(str(next(out.glob("requests_*")))).first()["request"])
    assert request["claims"][0]["evidence_span"] == "troops fled Kati"

    second = "https://example.com/mali-2"
    second_id = hashlib.sha256(second.encode()).hexdigest()[:16]
    _feed(tmp_path / f"feeds-{DAY_2}", "DW", ("Mali talks", second, "Talks.", "Sun, 19 Apr 2026 10:00:00 GMT"))
    answers = tmp_path / f"replies-{DAY_2}"
    _reply(answers, "labels", {"results": [
        {"id": second_id, "theme": "Geopolitics & War", "story_label": "Mali Talks", "importance": 4}]})
    _reply(answers, "matches", {"matches": [
        {"today_label": "Mali Talks", "canonical_label": "Mali Attacks"}]})
    out = _main(tmp_path, DAY_2, "--skip-digest")

    assert not list(out.glob("digest_*"))
    row = spark.read.parquet(str(next(out.glob("edition_*")))).first()
    assert (row["canonical_label"], row["tag"], row["location"]["label"]) == (
        "Mali Attacks", "CONTINUING STORY", "Mali",
    )
    assert "Previously: Attacks shook Mali." in row["body"]
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.read("stories").count() == 1
    assert sorted(str(r["date"]) for r in store.read("story_daily").collect()) == [DAY_1, DAY_2]
    assert store.read("claims").count() == 1
    snapshot = spark.read.json(str(tmp_path / "state" / "snapshots"))
    assert sorted(str(r["date"]) for r in snapshot.select("date").distinct().collect()) == [DAY_1, DAY_2]


def test_scratch_state_leaves_the_state_alone(spark, tmp_path):
    _feed(tmp_path / f"feeds-{DAY_1}", "NOS", ("T", "https://example.com/1", "", "Sat, 18 Apr 2026 10:00:00 GMT"))
    _main(tmp_path, DAY_1, "--scratch-state", str(tmp_path / "scratch"), "--skip-briefing", "--skip-edition")
    assert not (tmp_path / "state").exists()
    assert StateStore(spark, str(tmp_path / "scratch")).read("articles").count() == 1


def test_empty_rerun_keeps_the_day(spark, tmp_path):
    _feed(tmp_path / f"feeds-{DAY_1}", "NOS", ("T", "https://example.com/1", "", "Sat, 18 Apr 2026 10:00:00 GMT"))
    _main(tmp_path, DAY_1, "--skip-briefing", "--skip-edition")
    (tmp_path / f"feeds-{DAY_1}" / "NOS.xml").write_text("<rss><chan")
    _main(tmp_path, DAY_1, "--skip-briefing", "--skip-edition")
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.read("articles").count() == 1
    assert store.read("story_daily").count() == 1


def test_unknown_feeds_and_run_reports(spark, tmp_path):
    feeds = tmp_path / f"feeds-{DAY_1}"
    _feed(feeds, "My Feed", ("A", "https://example.com/a", "d", "Sat, 18 Apr 2026 10:00:00 GMT"))
    _feed(feeds, "NOS", ("B", "https://example.com/b", "", "Sat, 18 Apr 2026 10:00:00 GMT"), ("C", "https://example.com/c", "", "x"))
    answers = tmp_path / f"replies-{DAY_1}"
    (answers / "matches").mkdir(parents=True)
    (answers / "matches" / "part.json").write_text(json.dumps({"reply_no": 3, "article_id": None, "reply": "{"}) + "\n")
    out = _main(tmp_path, DAY_1, "--show-evidence", "--skip-briefing", "--skip-edition", "--allow-bad-replies")
    articles = StateStore(spark, str(tmp_path / "state")).read("articles").collect()
    assert {(r["source"], r["title"]) for r in articles} == {("My Feed", "A"), ("NOS", "B")}
    run = out / f"run_{DAY_1}"

    def rows(name):
        return spark.read.parquet(str(run / name)).collect()

    assert [r["reject_reason"] for r in rows("rejects")] == ["invalid_json"]
    assert sum(r["items"] for r in rows("skips") if r["source"] is None) == 1
    assert json.loads(rows("label_requests")[0]["request"])[0]["title"] == "B"  # catalogue feeds first
    counters = rows("tracking_counters")[0]
    assert (counters["labels"], counters["stories"], counters["new_stories"]) == (1, 1, 1)
    assert {r["kind"] for r in rows("match_requests")} == {"today"}
    assert len(rows("claim_requests")) == 2


def test_replies_to_parts_are_merged_in_order(spark):
    from helpers import replies
    from storyloom.sources.replies import briefing_replies

    def reply(*items):
        return json.dumps({"briefings": list(items)})

    first = {"canonical_label": "A", "briefing": "one", "delta_summary": "d"}
    second = {"canonical_label": "A", "part": 1, "briefing": "two"}
    old = {"canonical_label": "A", "part": 1, "briefing": "old"}
    found = briefing_replies(replies(spark, reply(old), reply(second, first))).collect()
    assert [(r["canonical_label"], r["briefing"], r["delta_summary"]) for r in found] == [("A", "one\n\ntwo", "d")]


@pytest.mark.parametrize("kind", ["labels", "groups", "matches", "briefings"])
def test_unreadable_replies_stop_the_run_before_state_is_written(spark, tmp_path, kind):
    _feed(tmp_path / f"feeds-{DAY_1}", "NOS", ("T", "https://example.com/1", "", "Sat, 18 Apr 2026 10:00:00 GMT"))
    _reply(tmp_path / f"replies-{DAY_1}", kind, {"answer": []})
    with pytest.raises(daily.UnreadableReplies, match=f"{kind} 0: missing_list"):
        _main(tmp_path, DAY_1)
    assert not (tmp_path / "state").exists()
    rejects = spark.read.parquet(str(tmp_path / f"out-{DAY_1}" / f"run_{DAY_1}" / "rejects"))
    assert [r["kind"] for r in rejects.collect()] == [kind]


def test_unread_feeds_are_kept_beside_the_run(spark, tmp_path):
    feeds = tmp_path / f"feeds-{DAY_1}"
    _feed(feeds, "NOS", ("T", "https://example.com/1", "", "Sat, 18 Apr 2026 10:00:00 GMT"))
    (feeds / "DW.xml").write_text("<rss><channel><item><title>T</title></item><item>")
    (feeds / "BBC.xml").write_text("<html><body>gone</body></html>")
    out = _main(tmp_path, DAY_1, "--skip-briefing", "--skip-edition", "--skip-digest")
    unread = spark.read.parquet(str(out / f"run_{DAY_1}" / "feed_rejects")).collect()
    assert {(r["source"], r["reject_reason"], r["unread"][:6]) for r in unread} == {
        ("DW", "malformed_xml", "<rss><"), ("BBC", "no_feed", "<html>"),
    }
