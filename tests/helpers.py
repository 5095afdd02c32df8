"""Small inputs shared by the tests."""

from pyspark.sql import functions as F

NOON = "Sat, 18 Apr 2026 12:00:00 GMT"
ITEM = "source string, language string, item_pos bigint, ordinal bigint, title string, url string, description string, published_at string"
LABELED = (
    "id string, source string, language string, title string, description string, url string, "
    "published_at string, text string, theme string, story_label string, importance int, ordinal bigint"
)
REPLY = "reply_no bigint, article_id string, reply string"


def items(spark, *rows):
    """(source, title, url, published_at) rows in feed order."""
    positions, out = {}, []
    for ordinal, (source, title, url, published) in enumerate(rows):
        pos = positions[source] = positions.get(source, -1) + 1
        out.append((source, "en", pos, ordinal, title, url, "Description", published))
    return spark.createDataFrame(out, ITEM)


def labeled(spark, *rows):
    """(id, story_label, source, theme, importance) rows."""
    out = [
        (str(i), source, "en", f"Title {i}", "Description", f"https://example.com/{i}", NOON, "",
         theme, label, importance, ordinal)
        for ordinal, (i, label, source, theme, importance) in enumerate(rows)
    ]
    return spark.createDataFrame(out, LABELED)


def replies(spark, *texts):
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], REPLY)


def tracked(spark, *rows, **extra):
    """(id, canonical_label, source, theme, importance) rows as tracked articles."""
    from storyloom.functions.dates import parse_reported

    context = "struct<last_observed: date, summary: string, delta_summary: string>"
    df = (
        labeled(spark, *rows)
        .withColumn("canonical_label", F.col("story_label"))
        .withColumn("trend", F.lit("new"))
        .withColumn("story_id", F.lit(42).cast("bigint"))
        .withColumn("observation_id", F.lit(None).cast("bigint"))
        .withColumn("previous_context", F.lit(None).cast(context))
        .withColumn("reported_ts", parse_reported("published_at"))
    )
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df


def column(df, name):
    return [r[name] for r in df.collect()]


def lines(df, order):
    return [r["line"] for r in df.orderBy(*order).collect()]
