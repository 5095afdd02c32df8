import pytest
from helpers import NOON, column, items
from pyspark.sql import functions as F

from storyloom.functions.dates import reported_text
from storyloom.functions.urls import article_id, normalize_url
from storyloom.operators.intake import cap_per_source
from storyloom.plans.ingest import ingest
from storyloom.sources.feeds import feed_catalogue, parse_items, read_feeds
from storyloom.sources.pages import page_text

DAY_BEFORE = "Fri, 17 Apr 2026 10:00:00 GMT"


def test_text_is_empty_without_pages_and_filled_with_them(spark):
    rows = items(spark, ("A", "T", "https://example.com/a", NOON), ("A", "U", "https://example.com/b", NOON))
    assert column(ingest(rows).articles, "text") == ["", ""]
    pages = spark.createDataFrame(
        [("https://example.com/a", "<body><nav>x</nav><article>Full text</article></body>")],
        "url string, html string",
    )
    texts = {r["url"]: r["text"] for r in ingest(rows, pages=pages).articles.collect()}
    assert texts == {"https://example.com/a": "Full text", "https://example.com/b": ""}


@pytest.mark.parametrize("cap, kept", [(None, 12), (5, 5), (5000, 12)])
def test_cap(spark, cap, kept):
    rows = items(spark, *[("A", f"T{i}", f"https://example.com/{i}", NOON) for i in range(12)])
    assert ingest(rows, cap=cap).articles.count() == kept


def test_cap_beyond_the_pruned_size_keeps_the_first_items_of_a_hot_source(spark):
    rows = spark.range(0, 5000).select(
        F.lit("hot").alias("source"), F.col("id").alias("item_pos")
    )
    kept = cap_per_source(rows, 3000).agg(F.count("*"), F.max("item_pos")).first()
    assert tuple(kept) == (3000, 2999)


def test_date_filter_and_skip_report(spark):
    rows = items(
        spark,
        ("Example A", "Today", "https://example.com/today", NOON),
        ("Example A", "Yesterday", "https://example.com/yesterday", DAY_BEFORE),
        ("Example A", "Missing", "https://example.com/missing", ""),
        ("Example A", "Bad", "https://example.com/bad", "not a date"),
        ("Example B", "Also missing", "https://example.org/missing", ""),
    )
    out = ingest(rows, "2026-04-18")
    assert column(out.articles, "title") == ["Today"]
    got = {(r["skip_reason"], r["source"]): r["items"] for r in out.skips.collect()}
    assert got == {
        ("outside_date", "Example A"): 1,
        ("outside_date", None): 1,
        ("missing_timestamp", "Example A"): 1,
        ("missing_timestamp", "Example B"): 1,
        ("missing_timestamp", None): 2,
        ("unparseable_timestamp", "Example A"): 1,
        ("unparseable_timestamp", None): 1,
    }


def test_cap_counts_items_of_the_day_and_repeats(spark):
    rows = items(
        spark,
        ("A", "Stale", "https://example.com/stale", DAY_BEFORE),
        ("A", "Today", "https://example.com/today", NOON),
        ("A", "Same address", "https://example.com/today#top", NOON),
        ("A", "Third", "https://example.com/third", NOON),
    )
    assert column(ingest(rows, "2026-04-18", 1).articles, "title") == ["Today"]
    assert column(ingest(rows, "2026-04-18", 2).articles, "title") == ["Today"]


def test_first_arrival_of_an_address_wins_and_empty_addresses_are_one(spark):
    rows = items(
        spark,
        ("A", "First", "https://example.com/x?utm_source=a", NOON),
        ("B", "Second", "https://EXAMPLE.com/x/", NOON),
        ("B", "No link", "", NOON),
        ("A", "No link either", "", NOON),
    )
    assert sorted(column(ingest(rows).articles, "title")) == ["First", "No link"]


@pytest.mark.parametrize(
    "raw, normalized",
    [
        ("https://Example.com/story?b=2&utm_source=newsletter", "https://example.com/story?b=2"),
        ("https://example.com/story/?fbclid=abc&b=2", "https://example.com/story?b=2"),
        ("HTTP://A.B/?z=1&a=&a=%20x&k", "http://a.b/?a=&a=+x&k=&z=1"),
        ("https://a.b///", "https://a.b///"),
        ("https://a.b/p?q=~*+%2B", "https://a.b/p?q=~%2A+%2B"),
        ("https://a.b/p?UTM_x=1#frag", "https://a.b/p?UTM_x=1"),
        ("https://a.b/p?x=100%", "https://a.b/p?x=100%25"),
        ("/only/path/", "/only/path"),
        ("", ""),
    ],
)
def test_normalize_url(spark, raw, normalized):
    row = spark.range(1).select(normalize_url(F.lit(raw)).alias("u")).first()
    assert row["u"] == normalized


def test_article_id_is_a_hash_prefix(spark):
    import hashlib

    url = "https://example.com/story?b=2"
    got = spark.range(1).select(article_id(F.lit(url)).alias("i")).first()["i"]
    assert got == hashlib.sha256(url.encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "raw, shown",
    [
        (NOON, "2026-04-18 12:00 UTC"),
        ("18 Apr 2026 10:00 +0200", "2026-04-18 08:00 UTC"),
        ("Sat, 18 Apr 26 20:30:00 EST", "2026-04-19 01:30 UTC"),
        ("Sat, 31 Feb 2026 10:00:00 GMT", "Sat, 31 Feb 2026 10:00:00 GMT"),
        ("soon", "soon"),
        ("", "unknown time"),
        (None, "unknown time"),
    ],
)
def test_reported_text(spark, raw, shown):
    row = spark.range(1).select(reported_text(F.lit(raw).cast("string")).alias("t")).first()
    assert row["t"] == shown


FLAT = [
    ("<article><h1>A &amp; B</h1><p>one<br>two<!-- no --></p></article>", "A & B\none\ntwo"),
    ("<main>m</main>", "m"),
    ("<main>m</main><article>a<script>if (1 < 2) {}</script>b</article>", "a\nb"),
    ("<article>x\n\n\n\n<p>y</p></article>", "x\n\ny"),
    ("<article>&#233;&#xE9;&eacute;&nope;&am</article>", "ééé&nope;&am"),
    ("<p>none</p>", ""),
    ("<article>cut off", "cut off"),
    (None, ""),
]


@pytest.mark.parametrize("nested", [False, True])
def test_main_text(spark, nested):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(FLAT)], "i int, html string")
    got = {r["i"]: r["text"] for r in page_text(pages, nested).collect()}
    assert [got[i] for i in range(len(FLAT))] == [text for _, text in FLAT]


@pytest.mark.parametrize("nested", [False, True])
def test_references_that_are_cut_off_stay(spark, nested):
    html = "<article><h1>and&amp</h1><p>&lt &copy, &#233 &notit; &amp;amp &&amp;</p></article>"
    pages = spark.createDataFrame([(html,)], "html string")
    assert column(page_text(pages, nested), "text") == ["and&amp\n&lt &copy, &#233 &notit; &amp &&"]


def test_nested_markup_needs_the_parser(spark):
    html = "<article>a<nav>x<nav>y</nav>z</nav><article>b</article>c</article>"
    pages = spark.createDataFrame([(html,)], "html string")
    assert column(page_text(pages, nested=True), "text") == ["a\nb\nc"]


RSS = """<rss><channel><title>Feed</title>
<item><title><![CDATA[ A & B ]]></title><link>https://example.com/1</link><pubDate>x</pubDate></item>
<item><title>Second</title><description>&lt;p&gt;d&lt;/p&gt;</description></item>
</channel></rss>"""
RDF = "<RDF><channel><title>t</title></channel><item><title>R</title></item></RDF>"


def test_feed_files(spark, tmp_path):
    (tmp_path / "NOS.xml").write_text(RSS)
    (tmp_path / "DW.xml").write_text(RDF)
    (tmp_path / "BBC News.xml").write_text("<rss><channel><item><title>broken")
    rows = read_feeds(spark, str(tmp_path))[0].orderBy("ordinal").collect()
    assert [(r["source"], r["item_pos"], r["title"], r["url"]) for r in rows] == [
        ("NOS", 0, "A & B", "https://example.com/1"),
        ("NOS", 1, "Second", ""),
        ("DW", 0, "R", ""),
    ]
    assert rows[1]["description"] == "<p>d</p>"


def test_catalogue_keeps_priority(spark):
    rows = feed_catalogue(spark).orderBy("source_rank").collect()
    assert (len(rows), rows[0]["source"], rows[-1]["source"]) == (21, "NOS", "DW")
    feeds = spark.createDataFrame([("X", "en", 3, RSS)], "source string, language string, source_rank bigint, xml string")
    assert column(parse_items(feeds), "ordinal") == [3 * 2**32, 3 * 2**32 + 1]
