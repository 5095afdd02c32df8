"""Mail-style dates, skip reasons and reported times.

Reported times are ``timestamp_ntz`` in UTC, so results do not depend on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import as_col, clean

# Zone names of mail dates by offset; other names count as UTC.
_ZONES = {
    "-0300": "ADT",
    "-0400": "AST|EDT",
    "-0500": "EST|CDT",
    "-0600": "CST|MDT",
    "-0700": "MST|PDT",
    "-0800": "PST",
    "+0000": "[A-Za-z]+",
}
_FORMAT = "d MMM yyyy H:mm[:ss] xx"
# The spelling that nearly all dates have, with the place and length of what the format reads.
_USUAL = r"^[A-Za-z]{3}, \d\d [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d (?:GMT|[+-]\d{4})$"
_USUAL_START, _USUAL_LENGTH = 6, 21


def parse_reported(raw: Column | str) -> Column:
    """Mail date -> UTC time; null when the text is not one.

    The usual spelling is cut out as it stands. Other text is brought to one spelling step by
    step, so every step reads the one before it once and the expression stays small.
    """
    found = clean(raw)
    zone = F.replace(F.substring(found, _USUAL_START + _USUAL_LENGTH, 5), F.lit("GMT"), F.lit("+0000"))
    usual = F.concat(F.substring(found, _USUAL_START, _USUAL_LENGTH), zone)
    text = F.regexp_replace(found, r"\s*\(.*\)$", "")
    text = F.regexp_replace(text, r"^[A-Za-z]+,?\s+", "")
    text = F.regexp_replace(text, r"^(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+", "$1 $2 ")
    text = F.regexp_replace(text, r"^(\d+ \w{3}) (6[0-8]|[0-5]\d)\s", "$1 20$2 ")
    text = F.regexp_replace(text, r"^(\d+ \w{3}) (\d\d)\s", "$1 19$2 ")
    for offset, names in _ZONES.items():
        text = F.regexp_replace(text, rf"(?i)(\d)\s*(?:{names})$", f"$1 {offset}")
    text = F.regexp_replace(text, r"(:\d\d)$", "$1 +0000")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.when(found.rlike(_USUAL), usual).otherwise(text)
    moment = F.unix_seconds(F.try_to_timestamp(text, F.lit(_FORMAT)))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=moment)


def published_date(raw: Column | str) -> Column:
    """UTC calendar day of a mail date."""
    return parse_reported(raw).cast("date")


def skip_reason(raw: Column | str, target: Column | None) -> Column:
    """Why an item is not part of the target day; null keeps it.

    The date is parsed in one place only: a filter on the reason copies the
    expression, and each copy of the parser is compiled.
    """
    if target is None:
        return F.lit(None).cast("string")
    other_day = (published_date(raw) != target).cast("string")
    reasons = F.create_map(
        F.lit("true"), F.lit("outside_date"), F.lit("none"), F.lit("unparseable_timestamp")
    )
    return F.when(clean(raw) == "", F.lit("missing_timestamp")).otherwise(
        F.element_at(reasons, F.coalesce(other_day, F.lit("none")))
    )


def utc_minutes(moment: Column | str) -> Column:
    return F.concat(F.substring(as_col(moment).cast("string"), 1, 16), F.lit(" UTC"))


def reported_text(raw: Column | str, moment: Column | str | None = None) -> Column:
    """Reported minute in UTC, else the raw text, else a fixed phrase."""
    parsed = parse_reported(raw) if moment is None else as_col(moment)
    return F.coalesce(
        utc_minutes(parsed), F.nullif(as_col(raw), F.lit("")), F.lit("unknown time")
    )
