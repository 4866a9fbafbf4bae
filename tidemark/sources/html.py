"""Page parsing: body text by an ordered list of selectors, and links with the headings they stand under.

Parsing is Python's own, in Arrow batches, one page at a time; Spark deals out the pages. Broken markup never
raises: unclosed elements end with their parents. Null pages are empty pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Where a document's body is, most specific first, and what never belongs to it.
BODY_SELECTORS = ("div#article", "div.col-xs-12.col-sm-8.col-md-8", "div#content", "div#leftText", "td.text", "div.col-xs-12")
DROPPED = frozenset(("script", "style", "nav", "header", "footer"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h3", "h4", "h5"))
UNENDED = re.compile("<[A-Za-z/!?]")
WHOLE_PAGE = "whole_page_fallback"
#: Cleaned characters that a selector's text must have.
LEAST_BODY = 400


class Outline(HTMLParser):
    """A page in document order, in time in proportion to its length: ``pieces`` of text, each marked where it lies in
    something dropped, and ``elements``. What is asked of an element is noted as it opens: whether it lies in something
    dropped, the last heading before it and the element around it that is marked as a meeting. A link ends where the
    next begins, as links don't nest."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self.dropped: list[bool] = []
        self.open: list[int] = []
        self.opened: Counter[str] = Counter()
        self.heading, self.drops = -1, 0
        self.texts: dict[int, str] = {}
        # A tag that never ends is no text; looking for its end again and again takes time.
        cut = UNENDED.search(html, html.rfind(">") + 1)
        self.feed(html[: cut.start()] if cut else html)
        self.close()
        self.shut(0)

    def shut(self, depth: int) -> None:
        """Close the open elements beyond ``depth``."""
        for i in self.open[depth:]:
            own = self.elements[i]
            own.end = len(self.pieces)
            self.opened[own.tag] -= 1
            self.drops -= own.tag in DROPPED
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag == "a" and self.opened["a"]:
            self.handle_endtag("a")
        i, own = len(self.elements), {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        classes = own.get("class", "").split()
        meeting = i if any("fomc-meeting" in c for c in classes) else self.elements[parent].meeting if parent >= 0 else -1
        self.elements.append(Element(tag, own, frozenset(classes), parent, self.heading, meeting, self.drops > 0, len(self.pieces), len(self.pieces)))
        if tag in HEADINGS:
            self.heading = i
        if tag not in VOID:
            self.open.append(i)
            self.opened[tag] += 1
            self.drops += tag in DROPPED

    def handle_endtag(self, tag):
        if self.opened[tag]:
            at = len(self.open) - 1
            while self.elements[self.open[at]].tag != tag:
                at -= 1
            self.shut(at)

    def handle_data(self, data):
        self.pieces.append(data)
        self.dropped.append(self.drops > 0)

    def text(self, i: int) -> str | None:
        """The text of an element on one line; of none, None."""
        if i >= 0 and i not in self.texts:
            self.texts[i] = " ".join("".join(self.pieces[self.elements[i].start : self.elements[i].end]).split())
        return self.texts.get(i)

    def shown(self, start: int, end: int) -> str:
        return "\n".join(p for p, gone in zip(self.pieces[start:end], self.dropped[start:end], strict=True) if not gone)


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    classes: frozenset[str]
    parent: int
    heading: int
    meeting: int
    inside: bool
    start: int
    end: int

    def matches(self, selector: str) -> bool:
        tag, _, rest = selector.replace("#", ".#").partition(".")
        return self.tag == tag and all(self.attributes.get("id") == part[1:] if part.startswith("#") else part in self.classes for part in rest.split("."))


def body_candidates(html: str | None) -> list[tuple[str, str]]:
    """Of the first element of each selector its selector and text, one line for each piece; last, the whole page."""
    page = Outline(html or "")
    out = []
    for selector in BODY_SELECTORS:
        found = next((e for e in page.elements if e.matches(selector) and not e.inside), None)
        if found:
            out.append((selector, page.shown(found.start, found.end)))
    return [*out, (WHOLE_PAGE, page.shown(0, len(page.pieces)))]


def page_links(html: str | None, base: str | None) -> list[dict]:
    """Every link: ``href`` as written, ``url`` (absolute), ``text``, the last heading before its parent began
    (``heading``) and the text of the element around it that is marked as a meeting (``meeting``, 120 characters)."""
    page, out = Outline(html or ""), []
    for i, own in enumerate(page.elements):
        if own.tag != "a" or "href" not in own.attributes:
            continue
        href, around = own.attributes["href"], page.elements[own.parent] if own.parent >= 0 else None
        try:
            url = urljoin(base or "", href)
        except ValueError:
            url = href
        meeting = page.text(around.meeting) if around else None
        out.append({"href": href, "url": url, "text": page.text(i), "heading": page.text(around.heading) if around else None, "meeting": meeting and meeting[:120]})
    return out


def bodies(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, text, selector_used``: the first selector whose cleaned text is long enough, else the whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("selector", pa.string()), ("raw", pa.string())]))
        for batch in batches:
            found = [[{"selector": s, "raw": t} for s, t in body_candidates(h.as_py())] for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind)], names=[key, "found"])

    found = pages.select(key, "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, found array<struct<selector:string,raw:string>>")
    clean = F.transform("found", lambda f: F.struct(f["selector"].alias("selector"), T.clean_text(f["raw"]).alias("text")))
    best = F.get(F.filter("clean", lambda c: (F.length(c["text"]) >= LEAST_BODY) | (c["selector"] == WHOLE_PAGE)), F.lit(0))
    return found.withColumn("clean", clean).withColumn("best", best).select(key, F.col("best.text").alias("text"), F.col("best.selector").alias("selector_used"))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per link of each page: ``key, place, href, url, text, heading, meeting``."""
    fields = ("href", "url", "text", "heading", "meeting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f, pa.string()) for f in fields]))
        for batch in batches:
            found = [page_links(h.as_py(), u.as_py()) for h, u in zip(batch.column("html"), batch.column("url"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind)], names=[key, "found"])

    kinds = ",".join(f"{f}:string" for f in fields)
    found = pages.select(key, "url", "html").mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, found array<struct<{kinds}>>")
    return found.select(key, F.posexplode("found").alias("place", "link")).select(key, "place", "link.*")


def discovered(links_: DataFrame, modern: bool) -> DataFrame:
    """The links to statements and minutes as rows of the discovery table. On index pages of single years a statement is
    the link named Statement, on the modern calendar (``modern``) the one named HTML at an address that ends in ``a``."""
    statement = F.col("href").rlike("|".join(f"(?:{p})" for p in T.STATEMENT_URLS)) & (F.col("text") == "Statement")
    if modern:
        statement = F.col("href").rlike(T.MODERN_STATEMENT_URL) & (F.col("text") == "HTML")
    kind = F.when(statement, "statement").when(F.col("href").rlike(T.MINUTES_URL), "minutes")
    heading: Column = F.col("meeting" if modern else "heading")
    scheduled = T.is_scheduled(heading)
    if modern:  # every row of the calendar is a scheduled meeting unless it is marked otherwise
        scheduled = F.coalesce(scheduled, F.when(F.length(heading) > 0, F.lit(True)))
    found = links_.withColumns({"doc_type": kind, "doc_date": T.url_date(F.col("href")), "meeting_heading": heading, "is_scheduled": scheduled})
    return found.filter("doc_type is not null and doc_date is not null").select("doc_type", "doc_date", "url", F.col("text").alias("anchor_text"), "meeting_heading", "is_scheduled")
