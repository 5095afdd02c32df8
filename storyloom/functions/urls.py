"""URL normalisation and article ids."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.constants import TRACKING_PARAM_PREFIXES, TRACKING_PARAMS
from storyloom.functions.text import clean

# scheme, authority, path and query of a URL; the fragment is not captured
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_AUTHORITY_SCHEMES = ["http", "https", "ftp", "file"]


def _decode(text: Column) -> Column:
    # A percent sign without two hex digits stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _is_tracking(
    key: Column, names: list[str], prefixes: list[str]
) -> Column:
    by_prefix = [~F.startswith(key, F.lit(p)) for p in prefixes]
    return ~reduce(and_, by_prefix, ~key.isin(names))


def _query(
    raw: Column, names: list[str], prefixes: list[str]
) -> Column:
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda part: part != ""),
        lambda part: F.struct(
            _decode(F.regexp_extract(part, "(?s)^([^=]*)", 1)).alias("key"),
            _decode(F.regexp_extract(part, "(?s)^[^=]*=?(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.array_sort(
        F.filter(pairs, lambda p: ~_is_tracking(p["key"], names, prefixes))
    )
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))),
        "&",
    )


def normalize_url(
    url: Column | str,
    tracking_params: list[str] = TRACKING_PARAMS,
    tracking_prefixes: list[str] = TRACKING_PARAM_PREFIXES,
) -> Column:
    """One spelling per address.

    Scheme and host in lower case, no fragment, no tracking parameters, the rest
    sorted and re-encoded, no trailing slash (unless the path is slashes only).
    """
    raw = clean(url)

    def part(group: int) -> Column:
        return F.regexp_extract(raw, _PARTS, group)

    scheme, authority = F.lower(part(1)), F.lower(part(2))
    path = part(3)
    path = F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), path)
    rooted = (path == "") | F.startswith(path, F.lit("/"))
    location = (
        F.when(
            authority != "",
            F.concat(F.lit("//"), authority, F.when(rooted, path).otherwise(F.concat(F.lit("/"), path))),
        )
        .when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path))
        .when(scheme.isin(_AUTHORITY_SCHEMES) & rooted, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    query = _query(part(4), tracking_params, tracking_prefixes)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        location,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def article_id(normalized_url: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of a normalised URL."""
    return F.substring(F.sha2(normalized_url, 256), 1, 16)
