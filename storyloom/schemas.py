"""Declared schemas of inputs and state tables."""

ITEM = (
    "source string, language string, item_pos bigint, ordinal bigint, "
    "title string, url string, description string, published_at string"
)

ARTICLE = (
    "id string, source string, language string, title string, description string, "
    "url string, published_at string, text string, ordinal bigint"
)

PREVIOUS_CONTEXT = (
    "struct<last_observed: date, summary: string, delta_summary: string, recent_articles: "
    "array<struct<date: date, source: string, title: string, description: string, "
    "url: string, reported_at: string>>>"
)

_CONTEXT_ARTICLES = (
    "array<struct<date: date, source: string, title: string, description: string, "
    "url: string, reported_at: string>>"
)
_MEMORY = "struct<last_observed: date, summary: string, delta_summary: string>"

# name -> (schema, key). Tables with a date have a folder per date, others with a key keep
# changes by that key, the rest only grows.
STATE_TABLES = {
    "stories": ("story_id bigint, canonical_label string, theme string, created date", []),
    "story_daily": (
        "story_id bigint, date date, source_count bigint, importance_avg double, "
        "labels_seen string",
        [],
    ),
    "story_observations": (
        "observation_id bigint, story_id bigint, date date, label_seen string, "
        "source_count bigint, article_count bigint, importance_avg double, summary string, "
        "delta_summary string, novelty_score double",
        [],
    ),
    "articles": (
        "id string, story_id bigint, date date, source string, title string, "
        "description string, url string, published_at string, importance int",
        [],
    ),
    "article_story_links": (
        "article_id string, story_id bigint, observation_id bigint, relevance double, date date",
        [],
    ),
    # What later days need to know of a story day: its own part of the memory and of the
    # latest articles, and both as they stand after it.
    "story_days": (
        "story_id bigint, date date, canonical_label string, first_seen date, "
        f"previous_date date, source_count bigint, own_memory {_MEMORY}, "
        f"own_articles {_CONTEXT_ARTICLES}, memory {_MEMORY}, recent_articles {_CONTEXT_ARTICLES}",
        [],
    ),
    "article_labels": (
        "article_id string, url string, title string, description string, "
        "content_hash string, theme string, story_label string, importance int, "
        "model string, version string",
        ["article_id"],
    ),
    "claims": (
        "claim_id string, article_id string, story_id bigint, claim_text string, "
        "claim_type string, entities array<string>, evidence_span string, "
        "confidence double, version string",
        ["article_id", "version"],
    ),
    "claim_extractions": (
        "article_id string, version string, story_id bigint, content_hash string, "
        "claims_count bigint",
        ["article_id", "version"],
    ),
}
