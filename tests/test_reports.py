import json

import pytest
from helpers import column, lines, replies, tracked
from pyspark.sql import functions as F

from storyloom.functions.render import context_line, story_body
from storyloom.operators.rollup import story_rollup, with_score
from storyloom.operators.sections import edition_sections
from storyloom.operators.tables import missing_payloads
from storyloom.plans.briefing import (
    LINE_ORDER,
    briefing_lines,
    briefing_requests,
    briefing_stories,
    evidence_lines,
    fill_texts,
    story_memories,
)
from storyloom.plans.digest import LINE_ORDER as DIGEST_ORDER
from storyloom.plans.digest import digest_lines
from storyloom.plans.edition import edition_rows
from storyloom.operators.locations import story_locations
from storyloom.sources.replies import briefing_replies, payload_replies

STAMP = "2026-04-18 20:00"


def _payloads(spark, texts):
    rows = [(label, json.dumps(value)) for label, value in texts.items()]
    return payload_replies(spark.createDataFrame(rows, "canonical_label string, payload string"))


def _briefing(spark, rows, texts, n=3, retry=None, claims=None):
    picked = briefing_stories(rows, n)
    filled = fill_texts(picked, _payloads(spark, texts), retry and _payloads(spark, retry))
    return lines(briefing_lines(filled, rows, STAMP, claims), LINE_ORDER)


def test_empty_reports(spark):
    none = tracked(spark, (1, "A", "S", "Tech", 1)).limit(0)
    assert lines(digest_lines(none, STAMP), DIGEST_ORDER) == [
        "# News Digest", f"_Generated {STAMP} — 0 articles_", "", "No articles found.",
    ]
    got = lines(briefing_lines(fill_texts(briefing_stories(none), _payloads(spark, {"x": "y"})), none, STAMP), LINE_ORDER)
    assert got == ["# Top Developments", f"_{STAMP}_", "", "No tracked stories found."]


def test_digest_layout(spark):
    rows = tracked(
        spark,
        (1, "Small", "A", "Economy", 1), (2, "Big", "B", "Economy", 4), (3, "Big", "C", "Economy", 2),
        (4, "War", "D", "Geopolitics & War", 5), (5, "Odd", "E", "Unlisted", 5),
    ).withColumn("url", F.when(F.col("id") == "3", F.lit("")).otherwise(F.col("url")))
    when = "reported 2026-04-18 12:00 UTC"
    assert lines(digest_lines(rows, STAMP), DIGEST_ORDER) == [
        "# News Digest", f"_Generated {STAMP} — 5 articles_", "", "---", "",
        "## Geopolitics & War", "",
        "### \U0001f195 War _(importance 5)_", "", f"- D — {when} — [Title 4](https://example.com/4)", "",
        "## Economy", "",
        "### \U0001f195 Big _(importance 4)_", "",
        f"- B — {when} — [Title 2](https://example.com/2)", f"- C — {when} — Title 3", "",
        "### \U0001f195 Small _(importance 1)_", "", f"- A — {when} — [Title 1](https://example.com/1)", "",
    ]


def test_digest_by_story_label_without_trend(spark):
    rows = tracked(spark, (1, "A", "S", "Tech", 1)).drop("trend", "canonical_label")
    assert "###  A _(importance 1)_" in lines(digest_lines(rows, STAMP, "story_label"), DIGEST_ORDER)


def test_briefing_layout(spark):
    rows = tracked(spark, (1, "Example Story", "Example News", "Economy", 3))
    assert _briefing(spark, rows, {"Example Story": "Briefing text."}) == [
        "# Top Developments", f"_{STAMP}_", "",
        "## 1. NEW STORY Example Story",
        "_Economy — importance 3.0 — 1 source — latest reported 2026-04-18 12:00 UTC_", "",
        "**What changed today:** First detected today.", "",
        "Briefing text.", "",
        "Sources:",
        "- Example News — reported 2026-04-18 12:00 UTC — [Title 1](https://example.com/1)", "",
    ]


def test_missing_texts_are_asked_for_again_then_made_up(spark):
    rows = tracked(spark, (1, "Story A", "S1", "Geopolitics & War", 5), (2, "Story B", "S2", "Economy", 4))
    first = _payloads(spark, {"Story A": "Briefing A.", "Story B": ""})
    assert column(missing_payloads(briefing_stories(rows), first), "canonical_label") == ["Story B"]
    got = _briefing(spark, rows, {"Story A": "Briefing A."}, retry={"Story B": "Briefing B after retry."})
    assert "Briefing A." in got and "Briefing B after retry." in got
    got = "\n".join(_briefing(spark, rows, {"Story A": {"briefing": " ", "delta": " New turn. "}}))
    assert "Story A is included based on 1 source, with the latest report at 2026-04-18 12:00 UTC. " in got
    assert "The lead item is from S1: Title 1." in got
    assert "**What changed today:** New turn." in got


def test_texts_are_remembered_by_observation(spark):
    rows = tracked(spark, (1, "Example Story", "S", "Economy", 4), observation_id=F.lit(42).cast("bigint"))
    texts = {"Example Story": {"briefing": "Generated.", "delta_summary": "Clarified."}}
    filled = fill_texts(briefing_stories(rows), _payloads(spark, texts))
    assert [tuple(r) for r in story_memories(filled).collect()] == [(42, "Generated.", "Clarified.")]


def test_briefing_replies(spark):
    text = json.dumps({"briefings": [
        {"canonical_label": "A", "briefing": " one ", "delta": "d"},
        {"briefing": "no label"}, 3,
        {"canonical_label": "A", "briefing": "two", "delta_summary": " ", "delta": "last"},
    ]})
    got = briefing_replies(replies(spark, text)).collect()
    assert [tuple(r) for r in got] == [("A", "two", "last")]


def _context():
    return F.struct(
        F.lit(None).cast("date").alias("last_observed"), F.lit("Earlier summary.").alias("summary"),
        F.lit(None).cast("string").alias("delta_summary"),
    )


def test_requests_carry_context_and_claims(spark):
    rows = tracked(spark, (1, "Example Story", "Example News", "Economy", 4), previous_context=_context())
    claims = spark.createDataFrame(
        [("c1", "1", 42, "Text.", "fact", "Span.", 0.9, "", None, None)],
        "claim_id string, article_id string, story_id bigint, claim_text string, claim_type string, "
        "evidence_span string, confidence double, source string, article_title string, url string",
    )
    row = briefing_requests(rows, briefing_stories(rows), claims).first()
    request = json.loads(row["request"])
    assert list(request) == ["canonical_label", "articles", "previous_context", "claims"]
    assert request["previous_context"] == {"summary": "Earlier summary."}
    assert request["articles"] == [{
        "source": "Example News", "title": "Title 1", "description": "Description",
        "reported_at": "Sat, 18 Apr 2026 12:00:00 GMT", "url": "https://example.com/1",
    }]
    assert request["claims"] == [{
        "claim_text": "Text.", "claim_type": "fact", "evidence_span": "Span.", "confidence": 0.9,
        "source": "Example News", "article_title": "Title 1", "url": "https://example.com/1",
    }]


def test_a_large_story_is_asked_for_in_parts(spark):
    rows = tracked(spark, *[(i, "Big", f"S{i}", "Economy", 4) for i in range(7)])
    got = briefing_requests(rows, briefing_stories(rows), part_size=3).orderBy("part").collect()
    titles = [[a["title"] for a in json.loads(r["request"])["articles"]] for r in got]
    assert titles == [["Title 0", "Title 1", "Title 2"], ["Title 3", "Title 4", "Title 5"], ["Title 6"]]


def test_evidence_is_never_the_claim_text(spark):
    schema = (
        "claim_id string, story_id bigint, claim_type string, evidence_span string, "
        "confidence double, source string, url string"
    )
    rows = tracked(spark, (1, "Example Story", "S", "Economy", 4))
    shown = briefing_stories(rows)
    none = spark.createDataFrame([("c", 42, "fact", "", 0.9, "S", "u")], schema)
    assert evidence_lines(none, shown).count() == 0
    some = spark.createDataFrame(
        [("a", 42, "fact", "one", 0.29, "S", "https://u"), ("b", 42, "quote", "two", None, None, None),
         ("c", 42, "fact", "three", 0.0, "", "https://v")]
        + [(f"d{i}", 42, "number", f"n{i}", 0.99, "T", "") for i in range(7)],
        schema,
    )
    got = lines(evidence_lines(some, shown), LINE_ORDER)
    assert got[:3] == ["", "### Evidence", '- `number` — T — "n0" _(99%)_']
    assert len(got) == 10 and got[-1] == '- `fact` — [S](https://u) — "one" _(28%)_'


def test_sections_follow_the_editorial_rules(spark):
    rows = tracked(
        spark,
        (1, "Hormuz Strait", "S1", "Geopolitics & War", 5), (2, "US Congress", "S2", "USA Politics", 4),
        (3, "Dutch Cabinet", "S3", "Dutch Politics", 4), (4, "Oil Prices", "S4", "Economy", 4),
        (5, "Kinahan Arrest", "S5", "Other", 3), (9, "US Courts", "S9", "USA Politics", 3),
        (10, "Dutch Budget", "S10", "Dutch Politics", 3), (11, "China Sanctions", "S11", "Economy", 3),
        (12, "Celebrity Video", "S12", "Other", 4), (6, "Korfball Title", "S6", "Sports", 5),
        (7, "AI Opinion Piece", "S7", "Tech", 4), (8, "Minor Health Story", "S8", "Science", 4),
    )
    got = {}
    for r in briefing_stories(rows).orderBy("section_rank", "rank").collect():
        got.setdefault(r["section_rank"], []).append(r["canonical_label"])
    assert got == {
        1: ["Hormuz Strait", "US Congress", "Dutch Cabinet"],
        2: ["US Courts", "Dutch Budget"],
        3: ["Oil Prices", "China Sanctions"],
        4: ["Kinahan Arrest"],
    }
    text = _briefing(spark, rows, {"x": "y"})
    assert [t for t in text if t.startswith("# ")] == [
        "# Top Developments", "# Politics", "# Economy", "# Other Important Stories",
    ]


def test_one_story_over_several_themes(spark):
    rows = tracked(
        spark, (1, "Iran War", "A", "Geopolitics & War", 5), (2, "Iran War", "B", "Economy", 4),
        (3, "Iran War", "C", "USA Politics", 4),
    )
    text = _briefing(spark, rows, {"Iran War": "Text."})
    assert sum(t == "## 1. NEW STORY Iran War" for t in text) == 1
    assert "_Geopolitics & War / USA Politics / Economy — importance 4.3 — 3 sources — latest reported 2026-04-18 12:00 UTC_" in text
    story = with_score(story_rollup(rows)).first()
    assert (story["theme"], story["source_count"]) == ("Geopolitics & War", 3)
    assert story["score"] == pytest.approx(13 / 3 * 100 + 36 + 1)


def test_partitioning_does_not_change_sections(spark):
    rows = tracked(spark, *[(i, f"Story {i % 9}", f"S{i % 4}", "Economy", 1 + i % 5) for i in range(60)])
    one, many = [
        [tuple(r) for r in briefing_stories(rows.repartition(n, "id"))
         .select("section_rank", "rank", "canonical_label").orderBy("section_rank", "rank").collect()]
        for n in (1, 16)
    ]
    assert one == many
    assert sorted(label for _, _, label in one) == [f"Story {i}" for i in range(9)]


def _movement(spark):
    rows = tracked(
        spark, (1, "Chad water clash", "A", "Other", 4), (2, "Iran diplomacy", "A", "Other", 4),
        (3, "Ukraine war", "A", "Other", 4), (4, "Old campaign story", "A", "Economy", 4),
        (5, "Strange", "A", "Economy", 4),
    )
    trends = F.create_map(*[F.lit(v) for v in ["1", "new", "2", "up", "3", "steady", "4", "down", "5", "?"]])
    return rows.withColumn("trend", trends[F.col("id")])


def test_edition_sections_by_movement(spark):
    shown = edition_sections(briefing_stories(_movement(spark))).orderBy("edition_rank")
    assert [(r["edition_title"], r["canonical_label"]) for r in shown.collect()] == [
        ("NEW TODAY", "Chad water clash"), ("DEVELOPING STORIES", "Iran diplomacy"),
        ("CONTINUING WATCH", "Ukraine war"), ("COOLING / LOWER PRIORITY", "Old campaign story"),
        ("BRIEFLY NOTED", "Strange"),
    ]


def test_edition_rows(spark):
    rows = _movement(spark)
    filled = fill_texts(briefing_stories(rows), _payloads(spark, {"Iran diplomacy": "Talks go on."}))
    got = {r["canonical_label"]: r for r in edition_rows(filled, rows).collect()}
    iran = got["Iran diplomacy"]
    assert iran["tag"] == "DEVELOPING" and iran["sources"] == "Sources: A"
    assert iran["meta"] == "Iran | Other | importance 4.0 | 1 source | latest 2026-04-18 12:00 UTC"
    assert iran["body"] == "What changed today: First detected today.\n\nTalks go on."


def _locate(spark, label, theme="Geopolitics & War", title="", description=""):
    rows = tracked(spark, (1, label, "S", theme, 4)).withColumn("title", F.lit(title)).withColumn(
        "description", F.lit(description)
    )
    return story_locations(rows).first()["location"]


@pytest.mark.parametrize(
    "label, theme, title, want",
    [
        ("Mali attacks", "Other", "", ("national", "Mali", "high", 1)),
        ("Quiet day", "Other", "a day in Kati", ("national", "Mali", "medium", 1)),
        ("Malician attacks", "Other", "", ("unknown", "Unknown", "low", 0)),
        ("Talks", "Other", "Iran, Gaza, Mali and Chad", ("multi-region", "Iran / Gaza / Mali +1", "medium", 3)),
        ("Trade", "Economy", "tariffs rise", ("global", "Global", "medium", 0)),
        ("Oil prices jump", "Other", "", ("global", "Global", "medium", 0)),
        ("U.S. vote", "Other", "", ("national", "United States", "high", 1)),
        ("Strait of  Hormuz closed", "Other", "", ("local", "Strait of Hormuz", "high", 1)),
    ],
)
def test_locations(spark, label, theme, title, want):
    got = _locate(spark, label, theme, title)
    assert (got["scope"], got["label"], got["confidence"], len(got["points"])) == want


def test_point_of_a_place(spark):
    got = _locate(spark, "Mali attacks")
    assert (got["points"][0]["lat"], got["points"][0]["lon"]) == (17.5707, -3.9962)


@pytest.mark.parametrize(
    "summary, line",
    [
        ("Previously: markets were reacting. More.", "markets were reacting."),
        ("earlier: PREVIOUSLY:  x? y", "x?"),
        ("no end", "no end"),
        (" ", ""),
        (None, ""),
        (" ".join(["word"] * 33 + ["last,", "more", "words."]), " ".join(["word"] * 33 + ["last"]) + "..."),
    ],
)
def test_context_line(spark, summary, line):
    row = spark.range(1).select(context_line(F.lit(summary).cast("string")).alias("x")).first()
    assert row["x"] == line


@pytest.mark.parametrize(
    "delta, trend, summary, briefing, body",
    [
        ("", "up", "Previously: before.", "Now.", "Previously: before.\n\nNow."),
        ("", "new", "before.", "Now.", "Now."),
        ("Change.", "up", None, "Now.", "What changed today: Change.\n\nNow."),
        ("", "new", None, "", "This story is included based on 2 sources, with the latest report at T. A generated briefing was not available."),
    ],
)
def test_story_body(spark, delta, trend, summary, briefing, body):
    cols = {"delta": delta, "trend": trend, "summary": summary, "briefing": briefing, "latest": "T"}
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in cols.items()], F.lit(2).alias("n"))
    assert row.select(story_body("delta", "trend", "summary", "briefing", "n", "latest").alias("b")).first()["b"] == body
