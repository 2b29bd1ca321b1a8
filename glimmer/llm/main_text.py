"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one a block element; elements that hold no article text by their name or by a word
of their class or id (menus, footers, adverts, forms, scripts, comments and the like) leave no line. A line weighs its
text outside links, and at least BONUS in an article or main element; a short line outside the page's article or main
elements weighs nothing. Weights are summed over sliding windows of lines. A run of lines begins where the sum surges
and ends where it dives, and the run with the most weight is the main text. What surrounds an article that makes up most
of the run is trimmed off its ends.

A null or empty page gives an empty text. Pages may be of any length (tags are found in one pass, and a tag ends
before the next "<"); repeated rows and null ids have a result each, other columns than the three are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import sliced

SPAN, SURGE, BONUS = 3, 80, 30
#: HTML's element names by their part here.
RAW = frozenset({"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "noembed", "noframes", "xmp"})
OUTSIDE = frozenset({"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "audio", "video", "canvas"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset({"article", "main"})
#: Words of class and id attributes that mark what isn't article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Class and id words of a page's own header, and first parts of words that tell of a layout.
HEADERS, LAYOUT = frozenset("header masthead page-header site-header top-bar topbar".split()), frozenset("has no not with without".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAMES = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)(?=[\s/>])")
#: One attribute, name by name: what is in a value is stepped over with it.
_ATTR = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"})


def _outside(name: str, attributes: str, contained: bool) -> bool:
    if name in OUTSIDE or (name == "header" and not contained):
        return True
    if name in CONTAINERS or name in ("html", "body") or not attributes:
        return False
    for key, a, b, c in _ATTR.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in _ROLES):
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                if parts and parts[0] not in LAYOUT and (parts[0] in MARKS or parts[-1] in MARKS):
                    return True
                if not contained and word.lower().replace("_", "-") in HEADERS:
                    return True
    return False


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, number of the outermost article or main element or 0) of each non-empty line."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    free = at = depth = count = skipping = links = 0
    skipped = ""
    lowered: str | None = None
    closed: frozenset[int] | None = None

    def flush() -> None:
        nonlocal text, free
        if text and (line := " ".join(html.unescape("".join(text)).split())):
            out.append((line, free, count if depth else 0))
        text, free = [], 0

    def add(piece: str) -> None:
        nonlocal free
        if piece and not skipping:
            text.append(piece)
            if not links:
                free += len(piece.strip())

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if skipping:
            if name == skipped and not attributes.endswith("/"):
                skipping += -1 if closing else 1
            continue
        if name in RAW and not closing:
            lowered = page.lower() if lowered is None else lowered
            if len(lowered) == len(page):
                end = lowered.find(f"</{name}", at)
            else:
                found = re.compile(f"</{name}", re.I).search(page, at)
                end = found.start() if found else -1
            at = len(page) if end < 0 else end
            continue
        if name in BLOCK:
            flush()
        if closing:
            if name in CONTAINERS and depth:
                depth -= 1
            elif name == "a" and links:
                links -= 1
            continue
        if name in VOID:
            continue
        if _outside(name, attributes, depth > 0):
            if name == "p":
                at = _end_of_paragraph(page, at)
                continue
            if closed is None:
                closed = _closed(page)
            if m.start() in closed:
                flush()
                skipped, skipping = name, 1
            continue
        if name in CONTAINERS:
            count += not depth
            depth += 1
        elif name == "a":
            links = 1
    add(page[at:])
    flush()
    return out


def _closed(page: str) -> frozenset[int]:
    """Where elements begin that have an end tag; one that has none leaves what follows in place."""
    opened: dict[str, list[int]] = {}
    found = []
    for m in _NAMES.finditer(page):
        own = opened.setdefault(m[2].lower(), [])
        if not m[1]:
            own.append(m.start())
        elif own:
            found.append(own.pop())
    return frozenset(found)


def _end_of_paragraph(page: str, at: int) -> int:
    for m in _TAG.finditer(page, at):
        if (m[2] or "").lower() in BLOCK - {"br"}:
            return m.end() if m[1] and m[2].lower() == "p" else m.start()
    return len(page)


def weights(found: list[tuple[str, int, int]], bonus: int = BONUS, surge: int = SURGE) -> list[int]:
    """What each line weighs in the distribution."""
    contained = any(c for _, _, c in found)
    return [max(free, bonus) if c else free if not contained or free >= surge else 0 for _, free, c in found]


def main_text(page: str | None, span: int = SPAN, surge: int = SURGE) -> str:
    """The text between surge and dive of the page's line blocks."""
    found = lines(page) if page else []
    if not found:
        return ""
    weight = weights(found)
    total = list(accumulate(weight, initial=0))
    window = [total[min(i + span, len(weight))] - total[i] for i in range(len(weight))]
    runs, i = [], 0
    while i < len(weight):
        if window[i] >= surge:
            j = i
            while j < len(weight) and window[j] > 0 and (window[j] >= surge // 4 or weight[j]):
                j += 1
            runs.append((total[j] - total[i], -i, j))
            i = j
        i += 1
    if runs:
        _, start, stop = max(runs)
        start = -start
    else:  # no surge: what the elements say, or all there is
        inside = [k for k, (_, _, c) in enumerate(found) if c]
        start, stop = (inside[0], inside[-1] + 1) if inside else (0, len(found))
    inside = [k for k in range(start, stop) if found[k][2]]
    if 2 * sum(weight[k] for k in inside) > total[stop] - total[start]:
        start, stop = inside[0], inside[-1] + 1
    while start < stop and runs and not weight[start]:
        start += 1
    return " ".join(t for t, _, _ in found[start:stop])


def extract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    base = pages.select(F.col(key).cast("long").alias("k"), F.col("url").cast("string").alias("url"), F.col(column).alias("h"))
    arrow = pa.schema([("k", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return base.mapInArrow(run, "k long, url string, text string, n_chars long").withColumnRenamed("k", key)
