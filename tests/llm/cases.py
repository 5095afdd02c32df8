"""Documents with nulls, empty, long and repeated texts, and columns with clashing names."""

import random

DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "_text string, _row string, fp bigint, copies int, score double, word string, row bigint, d bigint"
)
LABELS = "doc_id bigint, quality int, toxic int, text string"


def prose(seed, words, names="ab ere tion the of ing é ü wh st".split()):
    draw = random.Random(seed)
    text = " ".join("".join(draw.choices(names, k=draw.randint(1, 3))) for _ in range(words))
    return text + "."


def texts():
    base = prose(1, 300)
    return [
        (1, base),
        (2, base),  # an exact copy
        (3, base.replace("tion", "TION", 1)),  # the same but for case
        (4, prose(2, 200) + base[:900] + prose(3, 50)),  # shares a passage
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "One"),
        (9, "mail me at a.b@c.example.com or call +1 (212) 555-0100, card 4111 1111 1111 1111."),
        (10, prose(4, 20_000)),
        (11, "x" * 3000),
        (12, prose(5, 80)),
        (12, prose(6, 80)),  # a doc_id twice
        (13, prose(7, 90)),
        (13, prose(7, 90)),  # a row twice
        (None, prose(8, 60)),
        (14, "Naïve ﬁ ligature 東京 \U0001f600 1.2.3.4 and 999.1.1.1 <|endoftext|>"),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", "s", None, "a", "b", 1, 2, 0.5, "w", 3, 4) for i, t in rows], DOCS
    )


def labels(spark, rows=()):
    return spark.createDataFrame([(*r, "not this") for r in rows], LABELS)
