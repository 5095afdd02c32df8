"""Personal data: proposed by regular expressions, confirmed by checksums and context.

All of it is SQL functions. A span's start is the summed length of the gaps and matches
before it: ``split`` gives the gaps of the same pattern that ``regexp_extract_all`` gives
the matches of. No pattern crosses a line end, so lines are searched one by one and only
those that hold a digit or an @.

Base kinds: email, ip, card, phone. The method adds iban (mod-97), ssn (context words) and
secret (a key's name before a long token). Added spans never replace base ones.

Defined cases: a null text is empty; no spans give an empty list; repeated rows are kept;
spans of different kinds may overlap and are all reported; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.shared import whole_rows, whole_text

# Kinds in the order in which spans at one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]

# A match can only begin at the end of the one before or where the run before it can't be
# extended to the left; that and possessive quantifiers keep every search linear.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "secret": r"(?i:\b(?:api_?key|secret|token|passw(?:or)?d)\b\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/.-]{8,128}",
}

# Score of a proposal before its surroundings are read, by kind; the checksum is a must.
_START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "secret": 0.9}

# Words near a span that speak for it or against it.
_FOR = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|tax)\b",
    "secret": r"(?i)\b(?:key|secret|token|password)\b",
}
_AGAINST = r"(?i)\b(?:example|sample|test|version|isbn|order)\b"

CONTEXT_CHARS = 40
KEEP_SCORE = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (n - i) % 2 == 1,
            (lambda d: d * 2 - F.when(d > 4, 9).otherwise(0))(
                F.substring(digits, i, F.lit(1)).cast("int")
            ),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return (n > 0) & (total % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    chars = F.split(turned, "")
    rest = F.aggregate(
        F.filter(chars, lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def _small_number(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.try_to_number(short, F.lit("999")), F.lit(0)) <= 255)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _small_number)
    if kind == "card":
        digits = _digits(hit)
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _matches(line: Column, kind: str) -> Column:
    """Matches of one line: array of (start, end, hit), validated."""
    hits = F.regexp_extract_all(line, F.lit(_PATTERNS[kind]), F.lit(0))
    gaps = F.split(line, _PATTERNS[kind], -1)
    pairs = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"), hits.alias("hit")
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("found"),
    )

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        new = F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(
            end.alias("at"),
            F.when(pair["hit"].isNull(), state["found"])
            .otherwise(F.concat(state["found"], F.array(new)))
            .alias("found"),
        )

    found = F.aggregate(pairs, start, step, lambda state: state["found"])
    return F.filter(found, lambda m: _valid(kind, m["hit"]))


def _scored(line: Column, kind: str) -> Column:
    """Spans of one line: array of (start, rank, end, kind, score)."""

    def score(m: Column) -> Column:
        before = F.substring(
            line, F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0)) + 1,
            F.least(m["start"], F.lit(CONTEXT_CHARS)),
        )
        near = F.concat_ws(" ", before, F.substring(line, m["end"] + 1, F.lit(CONTEXT_CHARS)))
        raw = (
            F.lit(_START_SCORE[kind])
            + F.when(near.rlike(_FOR[kind]), 0.3).otherwise(0.0)
            - F.when(near.rlike(_AGAINST), 0.2).otherwise(0.0)
        )
        return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))

    spans = F.transform(
        _matches(line, kind),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            m["end"].alias("end"),
            F.lit(kind).alias("kind"),
            score(m).alias("score"),
        ),
    )
    if kind in BASE_KINDS:
        return spans
    return F.filter(spans, lambda s: s["score"] >= KEEP_SCORE)


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_spans``: array of (start, rank, end, kind, score), sorted.

    Offsets are code points, ends exclusive. Base spans hold whatever their score is; added
    ones need a score of ``KEEP_SCORE``.
    """
    none = F.array().cast(_SPANS)

    def of_line(line: Column) -> Column:
        digit = line.rlike("[0-9]")
        return F.concat(
            F.when(line.contains("@"), _scored(line, "email")).otherwise(none),
            *[F.when(digit, _scored(line, k)).otherwise(none) for k in KINDS if k not in ("email", "secret")],
            F.when(line.rlike("[=:]"), _scored(line, "secret")).otherwise(none),
        )

    # (start of the line, line) for the lines that can hold something
    lines = F.split(F.col("_text"), "\n", -1)
    placed = F.aggregate(
        lines,
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<at:int,line:string>>").alias("kept"),
        ),
        lambda state, line: F.struct(
            (state["at"] + F.length(line) + 1).alias("at"),
            F.when(
                line.rlike("[0-9@=:]"),
                F.concat(
                    state["kept"], F.array(F.struct(state["at"].alias("at"), line.alias("line")))
                ),
            )
            .otherwise(state["kept"])
            .alias("kept"),
        ),
        lambda state: state["kept"],
    )
    spans = F.flatten(
        F.transform(
            placed,
            lambda p: F.transform(
                of_line(p["line"]),
                lambda s: F.struct(
                    (s["start"] + p["at"]).alias("start"),
                    s["rank"].alias("rank"),
                    (s["end"] + p["at"]).alias("end"),
                    s["kind"].alias("kind"),
                    s["score"].alias("score"),
                ),
            ),
        )
    )
    return docs.withColumn("_text", whole_text()).withColumn(
        "pii_spans",
        F.when(F.col("_text").rlike("[0-9@=:]"), F.array_sort(spans)).otherwise(none),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document: base counts, digest of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE_KINDS))
    return find_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"),
        _listed(F.col("pii_spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0)).alias(
            "top_score"
        ),
    )


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind, such as <EMAIL>.

    Overlapping spans are replaced together, under the kind of the first. ``n_chars`` is
    counted anew where a text changed; texts without spans, null included, stay as they are.
    """
    names = docs.columns
    text = F.col("_text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= state["at"],
                F.concat(
                    state["out"],
                    F.substring(text, state["at"] + 1, s["start"] - state["at"]),
                    F.lit("<"),
                    F.upper(s["kind"]),
                    F.lit(">"),
                ),
            )
            .otherwise(state["out"])
            .alias("out"),
        )

    masked = F.aggregate(
        "pii_spans",
        start,
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    out = find_spans(whole_rows(docs)).withColumn(
        "_masked", F.when(F.size("pii_spans") > 0, masked)
    )
    changed = {"text": F.coalesce("_masked", "text")}
    if "n_chars" in names:
        changed["n_chars"] = F.coalesce(
            F.length("_masked").cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars")
        )
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])
