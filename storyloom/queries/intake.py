"""Feed items, dates, addresses and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.dates import parse_reported, reported_text, skip_reason
from storyloom.functions.text import claim_input, claim_input_hash, content_hash
from storyloom.functions.urls import article_id, normalize_url
from storyloom.operators.intake import cap_per_source, first_per_key
from storyloom.operators.intake import skip_report as report_skips
from storyloom.queries import adapters as a
from storyloom.queries.registry import query
from storyloom.sources.feeds import feed_rejects as unread_feeds
from storyloom.sources.feeds import parse_items, scan_feeds
from storyloom.sources.pages import page_text

_TARGET = "2024-01-15"
_CAP = 20


@query(f"""
WITH {a.ART},
marked AS (
  SELECT source, CASE WHEN published_at = '' THEN 'missing_timestamp'
                      WHEN reported_ts IS NULL THEN 'unparseable_timestamp'
                      WHEN CAST(reported_ts AS DATE) <> DATE '{_TARGET}' THEN 'outside_date'
                 END AS skip_reason
  FROM art
)
SELECT skip_reason, source, CAST(count(*) AS BIGINT) AS items
FROM marked WHERE skip_reason IS NOT NULL
GROUP BY GROUPING SETS ((skip_reason, source), (skip_reason))
""")
def skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that do not belong to a run date, by reason and source."""
    target = F.lit(_TARGET).cast("date")
    rows = a.articles(spark, sf_dir)
    return report_skips(rows.withColumn("skip_reason", skip_reason("published_at", target)))


@query(f"""
WITH {a.ART}
SELECT id, published_at, CAST(CAST(reported_ts AS DATE) AS VARCHAR) AS day,
       coalesce(strftime(reported_ts, '%Y-%m-%d %H:%M UTC'), nullif(published_at, ''),
                'unknown time') AS reported
FROM art
""")
def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail dates parsed to a UTC day and a report time."""
    rows = a.articles(spark, sf_dir).withColumn("_at", parse_reported("published_at"))
    return rows.select(
        "id",
        "published_at",
        F.col("_at").cast("date").cast("string").alias("day"),
        reported_text("published_at", "_at").alias("reported"),
    )


@query(f"""
WITH {a.ART}
SELECT source, CAST(date AS VARCHAR) AS date, id FROM art
QUALIFY row_number() OVER (PARTITION BY source, date ORDER BY ordinal) <= {_CAP}
""")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of every source and day, up to the cap."""
    rows = cap_per_source(a.articles(spark, sf_dir), _CAP, ["source", "date"], "ordinal")
    return rows.select("source", F.col("date").cast("string").alias("date"), "id")


_ADDRESS = r"""
parts AS (
  SELECT page_id, url, html,
         lower(regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?', 1)) AS scheme,
         lower(regexp_extract(trim(url), '^[^/?#]*//([^/?#]*)', 1)) AS host,
         regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
         regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages
),
params AS (
  SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '='
                             || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, v) AS query
  FROM (SELECT page_id, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS k,
               CASE WHEN contains(p, '=') THEN url_decode(replace(
                    substring(p, strpos(p, '=') + 1), '+', ' ')) ELSE '' END AS v
        FROM (SELECT page_id, unnest(string_split(query, '&')) AS p FROM parts) WHERE p <> '')
  WHERE NOT starts_with(k, 'utm_') AND k NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')
  GROUP BY page_id
),
address AS (
  SELECT p.page_id, p.url, p.html,
         p.scheme || '://' || p.host || coalesce(nullif(regexp_replace(p.path, '/+$', ''), ''), p.path)
           || coalesce('?' || q.query, '') AS address
  FROM parts p LEFT JOIN params q USING (page_id)
)"""


@query(f"""
WITH {_ADDRESS}
SELECT page_id, address, substring(sha256(address), 1, 16) AS article_id FROM address
""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised address and article id of every page."""
    pages = a.table(spark, sf_dir, "pages").withColumn("address", normalize_url("url"))
    return pages.select("page_id", "address", article_id("address").alias("article_id"))


@query(f"""
WITH {_ADDRESS}
SELECT address, page_id, url FROM address
QUALIFY row_number() OVER (PARTITION BY address ORDER BY page_id) = 1
""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of every address."""
    pages = a.table(spark, sf_dir, "pages").select(
        "page_id", "url", normalize_url("url").alias("address")
    )
    return first_per_key(pages, ["address"], "page_id").select("address", "page_id", "url")


def _sql_main_text() -> str:
    text = "html"
    for tag in ("script", "style", "noscript"):
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)', chr(1), 'g')"
    text = rf"regexp_replace({text}, '(?s)<!--.*?(-->|\z)', chr(1), 'g')"
    for tag in ("nav", "footer", "header", "aside", "form"):
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)', chr(1), 'g')"
    body = (
        rf"CASE WHEN regexp_matches(t, '(?is)<article\b') "
        rf"THEN regexp_extract(t, '(?is)<article\b[^>]*>(.*?)(</article\s*>|\z)', 1) "
        rf"ELSE regexp_extract(t, '(?is)<main\b[^>]*>(.*?)(</main\s*>|\z)', 1) END"
    )
    chars = "c"
    for name, char in [("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("nbsp", " "),
                       ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        chars = f"replace({chars}, '&{name};', '{char}')"
    return rf"""
WITH stripped AS (SELECT page_id, {text} AS t FROM pages),
body AS (SELECT page_id, {body} AS b FROM stripped),
lines AS (SELECT page_id, regexp_replace(regexp_replace(b, '<[^>]*>', chr(1), 'g'),
                 chr(1) || '+', chr(10), 'g') AS c FROM body)
SELECT page_id, regexp_replace(regexp_replace({chars}, '\n{{3,}}', chr(10) || chr(10), 'g'),
       '^\s+|\s+$', '', 'g') AS text
FROM lines
"""


@query(_sql_main_text())
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every landed page."""
    return page_text(a.table(spark, sf_dir, "pages").select("page_id", "html"), nested=False)


@query(_sql_main_text())
def main_text_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text read by the markup parser."""
    return page_text(a.table(spark, sf_dir, "pages").select("page_id", "html"), nested=True)


@query(f"""
WITH {a.TEXTS}
SELECT id, sha256(coalesce(title, '') || chr(10) || coalesce(description, '')) AS content_hash,
       sha256(c) AS claim_input_hash, CAST(length(c) AS BIGINT) AS claim_input_chars
FROM (SELECT *, regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10)
        || regexp_replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '^\\s+|\\s+$', '', 'g'),
        '^\\s+|\\s+$', '', 'g') AS c FROM texts)
""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that tell whether stored labels and claims still fit a text."""
    rows = a.texts(spark, sf_dir).withColumn("c", claim_input("title", "description"))
    return rows.select(
        "id",
        content_hash("title", "description").alias("content_hash"),
        claim_input_hash("c").alias("claim_input_hash"),
        F.length("c").cast("bigint").alias("claim_input_chars"),
    )


@query(f"""
WITH {a.ART}
SELECT source, CAST(row_number() OVER (PARTITION BY source, date, CAST(floor(id / 500) AS BIGINT)
                                       ORDER BY id) - 1 AS BIGINT) AS item_pos,
       title, url, description, published_at
FROM art
""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files (made from the articles, at most 500 items each) read back as items."""
    return parse_items(_feed_files(spark, sf_dir)).select(
        "source", "item_pos", "title", "url", "description", "published_at"
    )


def _feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files of at most 500 articles of a source and day."""
    def tag(name: str, value) -> Column:
        escaped = F.replace(F.replace(F.col(value), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.concat(F.lit(f"<{name}>"), escaped, F.lit(f"</{name}>"))

    item = F.concat(
        F.lit("<item>"), tag("title", "title"), tag("description", "description"),
        F.when(F.col("url") != "", tag("link", "url")).otherwise(F.lit("")),
        F.when(F.col("published_at") != "", tag("pubDate", "published_at")).otherwise(F.lit("")),
        F.lit("</item>"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", item.alias("item"))))
    return (
        a.articles(spark, sf_dir)
        .groupBy("source", "date", F.floor(F.col("id") / 500).alias("file"))
        .agg(F.array_join(F.transform(ordered, lambda r: r["item"]), "").alias("items"))
        .select(
            "source",
            "date",
            "file",
            F.lit("en").alias("language"),
            F.lit(0).cast("bigint").alias("source_rank"),
            F.concat(F.lit("<rss><channel><title>feed</title>"), "items", F.lit("</channel></rss>")).alias("xml"),
        )
    )


@query(f"""
WITH {a.ART},
files AS (SELECT DISTINCT source, date, CAST(floor(id / 500) AS BIGINT) AS file FROM art)
SELECT source, CAST(date AS VARCHAR) AS date, file,
       CASE WHEN file % 7 = 4 THEN 'no_feed' ELSE 'malformed_xml' END AS reject_reason
FROM files WHERE file % 7 IN (1, 3, 4, 5)
""")
def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files that were cut off, have a bare ampersand, are empty or are no feeds."""
    kind, xml = F.col("file") % 7, F.col("xml")
    damaged = (
        F.when(kind == 1, F.substring(xml, F.lit(1), F.length(xml) - 20))
        .when(kind == 3, F.replace(xml, F.lit("<title>feed"), F.lit("<title>a & b")))
        .when(kind == 4, F.lit("<html><body>not found</body></html>"))
        .when(kind == 5, F.lit(""))
        .otherwise(xml)
    )
    rows = unread_feeds(scan_feeds(_feed_files(spark, sf_dir).withColumn("xml", damaged)))
    return rows.select("source", F.col("date").cast("string").alias("date"), "file", "reject_reason")
