"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one for each block of the page. A line weighs as much as the text it has outside of links, and nothing in
parts that mark themselves as menus, adverts and the like, or outside the page's article where it has one. Sums of weights over sliding
windows of lines surge where there is text and lines without weight are where it dives; what lies between dives and holds a surge is the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; the window sum at which text begins. A page whose windows all lie under it begins at its greatest.
WINDOW, SURGE = 3, 60
#: Elements that hold no main text, elements that break lines, and names that parts give themselves.
SKIP = frozenset("head script style noscript template iframe svg canvas nav header footer aside form select button textarea dialog menu object".split())
BREAKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related sidebar share sharing social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
RAW = frozenset(("script", "style", "textarea", "title"))
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"=\s*[\"']|>")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _marked(attributes: str) -> bool:
    """Whether an element names itself as something beside the text."""
    for key, *value in _ATTRIBUTE.findall(attributes):
        words = _WORD.findall("".join(value).lower())
        if any(w in (ROLES if key.lower() == "role" else NAMES) for w in words):
            return True
    return False


def _tag(page: str, at: int, last: dict[str, int]) -> tuple[int, int, str, str, str] | None:
    """(start, end, slash, name, attributes) of the first piece of markup from a place on; the name is empty for comments and declarations.

    Only a quote after a `=` holds a `>` back, and only if it closes. Markup that never ends reaches to the end of the page. `last` holds the last places of
    quotes and `>`, so no character is passed over twice.
    """
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            return at, (len(page) if close < 0 else close + 3), "", "", ""
        found = _NAME.match(page, at)
        if found or page[at + 1 : at + 2] in ("!", "?", "/"):
            begin = end = found.end() if found else at + 2
            while end <= last[">"]:
                end = _STOP.search(page, end).end()
                quote = page[end - 1]
                if quote == ">":
                    return at, end, found[1] if found else "", found[2].lower() if found else "", page[begin : end - 1]
                if last[quote] >= end:
                    end = page.find(quote, end) + 1
            return at, len(page), "", "", ""
        at += 1
    return None


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, whether it is in an article) of each line of a page, without the parts that are skipped."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    plain = article = anchor = 0
    skip, depth = "", 0
    at, n, unclosed = 0, len(page), set[str]()

    def close() -> None:
        nonlocal plain
        if text := " ".join(html.unescape("".join(parts)).split()):
            lines.append((text, plain, article > 0))
        parts.clear()
        plain = 0

    def ends(name: str) -> int:
        """Where the next closing tag of this name begins; once there is none, it isn't sought again."""
        if name in unclosed:
            return n
        if (found := re.compile(f"</{name}", re.I).search(page, at)) is None:
            unclosed.add(name)
            return n
        return found.start()

    last = {c: page.rfind(c) for c in "\"'>"}
    while at < n:
        start, end, closing, name, attributes = _tag(page, at, last) or (n, n, "", "", "")
        text = page[at:start]
        if text and not skip:
            parts.append(text)
            plain += 0 if anchor else len(text)
        at = end
        if not name:
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else (0 if attributes.endswith("/") else 1)
            # an article or a body that begins inside a part that was never closed ends it
            if depth <= 0 or not closing and name in ("article", "main", "body"):
                skip, depth = "", 0
                if closing or name == "head":
                    continue
            elif name in RAW and not closing and (raw_end := ends(name)) < n:
                at = raw_end
                continue
            else:
                continue
        if not closing and name not in VOID and (name in SKIP or attributes and name not in ("html", "body", "article", "main") and _marked(attributes)):
            if name in BREAKS or name in SKIP:
                close()
            if not attributes.endswith("/"):
                skip, depth = name, 1
                if name in RAW:
                    at = ends(name)
            continue
        if name in BREAKS:
            close()
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            anchor = max(0, anchor + (-1 if closing else 1))
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
    close()
    return lines


def main_text(page: str | None) -> str:
    """The lines between dives among which text surges, joined by blank lines.

    A dive is a line without weight; where a page marks an article, lines outside of it have none, and links within it count as text. Of what lies between two dives all
    is kept if the sum of some window of it reaches SURGE, or the page's greatest sum, if that is less.
    """
    lines = page_lines(page or "")
    if not lines:
        return ""
    inside = any(x[2] for x in lines)
    weights = np.array([(len(t) if a else 0) if inside else w for t, w, a in lines], dtype=np.int64)
    sums = np.convolve(weights, np.ones(WINDOW, dtype=np.int64))
    surge = max(1, min(SURGE, int(sums.max())))
    kept: list[str] = []
    dives = [-1, *np.flatnonzero(weights == 0).tolist(), len(lines)]
    for low, high in zip(dives, dives[1:], strict=False):
        # a line lies in WINDOW windows; the densest of them decides whether text has surged there
        if high > low + 1 and sums[low + 1 : high + WINDOW - 1].max() >= surge:
            kept += [text for text, _, _ in lines[low + 1 : high]]
    return "\n\n".join(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null or empty html, and pages without main text, give an empty text. Repeated rows stay; other columns are ignored; an empty table gives an
    empty result. A page is read whole, however long.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")
