"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. A line's weight is its text length,
zero for lines inside navigation, headers, footers, asides, forms, scripts and the like, and,
where the page names its article or main part, for lines outside of that. Sums of weights
over sliding windows of lines surge where the main text begins and dive where it ends; the
weighted lines between are kept, whole and in page order.

Defined cases: null html is empty; a page without main text gives an empty text; repeated
rows are kept; unclosed and unknown tags, broken references and quotes are read as browsers
read them, roughly; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
# Without a named article: least characters of a window that is main text.
SURGE_CHARS = 80
# And the share of a line's text in links from which it is a menu.
LINK_SHARE = 0.5

# Fixed values of HTML: elements that begin and end a line.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Elements that never hold main text.
_LEFT_OUT = frozenset(
    "head nav header footer aside form script style noscript template textarea select button "
    "iframe object svg math canvas audio video dialog menu title xmp noembed noframes".split()
)
_MAIN = frozenset(("article", "main"))
# Words of class and id names, and roles, of parts that are not main text.
_PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
    "navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies "
    "consent notice notices alert popup modal overlay newsletter subscribe subscription share "
    "sharing social related recommended comment comments commentlist disqus replies pagination "
    "pager toolbar widget login signup search".split()
)
# In names of several words: first words that name the part whatever follows, those that do
# before a word for a box, and words that take the name back ("has-sidebar").
_FIRST_WORDS = frozenset("ad ads advert adverts advertisement comment comments cookie cookies disqus".split())
_BOX_WORDS = frozenset(
    "area bar block box button buttons container form group item items link links list panel section "
    "slot thread unit wrap wrapper".split()
)
_NOT_PARTS = frozenset("free has is no non not with without".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z))",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements that are never dropped for a name of theirs; in an article, headers neither.
_WHOLE = frozenset("html body main article".split())
_HEADERS = frozenset("header masthead banner".split())


@dataclass
class Line:
    text: str
    left_out: bool
    in_main: bool
    link_chars: int


@lru_cache(maxsize=65536)
def _names_part(token: str, in_main: bool) -> bool:
    """Whether a class or id names a part that is not main text."""
    words = _PART_WORDS - _HEADERS if in_main else _PART_WORDS
    parts = [p for p in re.split(r"[-_]+", token) if p]
    if not parts or _NOT_PARTS.intersection(parts):
        return False
    first, last = parts[0], parts[-1]
    return last in words or first in _FIRST_WORDS or (first in words and last in _BOX_WORDS)


def _is_part(name: str, attrs: str, in_main: bool) -> bool:
    """Whether an element is left out with all it holds."""
    if name in _LEFT_OUT:
        return not (in_main and name == "header")
    if len(attrs) < 4:
        return False
    for key, *values in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and name not in _WHOLE:
            if any(_names_part(token, in_main) for token in value.split()):
                return True
        if key == "role" and value in _ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "hidden":
            return True
    return False


def lines(html: str) -> list[Line]:
    """The page's blocks of text, in order."""
    found: list[Line] = []
    # Open elements: (name, whether it is left out, whether it is main).
    stack: list[tuple[str, bool, bool]] = []
    left_out = in_main = in_link = 0
    parts: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append(Line(text, left_out > 0, in_main > 0, link_chars))
        parts.clear()
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            parts.append(text)
            if in_link:
                link_chars += len(text.strip())

    def pop() -> None:
        nonlocal left_out, in_main, in_link
        name, part, main = stack.pop()
        left_out -= part
        in_main -= main
        in_link -= name == "a"

    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            add(html[at:])
            break
        add(html[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            flush()
        elif name == "br":
            add(" ")
        if tag["close"]:
            if any(name == open_name for open_name, _, _ in stack):
                while True:
                    done = stack[-1][0] == name
                    if stack[-1][0] in _BLOCKS:
                        flush()
                    pop()
                    if done:
                        break
            continue
        if name in _RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = closing.end() if closing else end
            continue
        attrs = tag["attrs"]
        if name in _VOID or attrs.endswith("/>"):
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop()  # its end tag was left out
        part = _is_part(name, attrs, in_main > 0)
        if part and name not in _BLOCKS:
            flush()
        main = name in _MAIN
        stack.append((name, part, main))
        left_out += part
        in_main += main
        in_link += name == "a"
    flush()
    return found


def main_text(html: str) -> str:
    """The main text of a page."""
    found = lines(html)
    named = any(line.in_main and not line.left_out for line in found)
    weights = []
    for line in found:
        weight = 0 if line.left_out else len(line.text)
        if named:
            weight *= line.in_main
        elif line.link_chars > LINK_SHARE * len(line.text):
            weight = 0
        weights.append(weight)
    # A window starts at every line and may hang over the last.
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    least = 1 if named else min(SURGE_CHARS, max(sums, default=0)) or 1
    high = [i for i, total in enumerate(sums) if total >= least]
    if not high:
        return ""
    surge, dive = high[0], high[-1] + WINDOW
    return "\n".join(
        line.text
        for line, weight in list(zip(found, weights, strict=True))[surge:dive]
        if weight
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    schema = T.StructType(
        [
            pages.schema["page_id"],
            pages.schema["url"],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return pages.select("page_id", "url", html).mapInArrow(read, schema)
