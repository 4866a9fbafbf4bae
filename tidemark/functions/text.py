"""Text functions of event documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and phrases that results depend on.
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"
LEAST_SENTENCE = 15
BOILERPLATE = (
    r"(?iU)^\s*(voting (for|against) the |voting for the fomc monetary policy action|in taking the discount rate action"
    r"|in a related action, the board of governors (approved|voted)|the board of governors of the federal reserve system (approved|voted)"
    r"|absent and not voting|release date:|for (immediate )?release)"
)
ERROR_PHRASES = ("page not found", "the page you were looking for has been moved", "no longer exists")
UNSCHEDULED = ("conference call", "unscheduled", "notation vote", "videoconference")
RELEASE_TIME = r"(?i)for\s+release\s+at\s+(\d{1,2})[:.](\d{2})\s*([ap])\.?\s*m\.?"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, least: int = LEAST_SENTENCE) -> Column:
    """The sentences of a text as an array; null and empty texts have none."""
    return lines_of(F.split(stripped(F.coalesce(text, F.lit(""))), SENTENCE_END), least)


def lines_of(parts: Column, least: int = LEAST_SENTENCE) -> Column:
    """The lines of the parts of a text, stripped, without those too short to be sentences."""
    lines = F.flatten(F.transform(parts, lambda s: F.split(s, "\n")))
    return F.filter(F.transform(lines, stripped), lambda s: F.length(s) >= least)


def is_boilerplate(sentence: Column) -> Column:
    return sentence.rlike(BOILERPLATE)


def is_error_page(text: Column) -> Column:
    start, found = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 600)), F.lit(False)
    for phrase in ERROR_PHRASES:
        found = found | start.contains(phrase)
    return found


def release_minutes(text: Column) -> Column:
    """Minutes after midnight of the release time that a text states; null where it states none, or no valid one."""
    start = F.substring(text, 1, 1500)
    hour, minute, half = (F.nullif(F.regexp_extract(start, RELEASE_TIME, i), F.lit("")) for i in (1, 2, 3))
    hour, minute = hour.cast("int"), minute.cast("int")
    return F.when((hour >= 1) & (hour <= 12) & (minute < 60), hour % 12 * 60 + F.when(F.lower(half) == "p", 720).otherwise(0) + minute)


def is_scheduled(heading: Column) -> Column:
    """False with a marker of unscheduled meetings, true with the word meeting, else null."""
    text, marked = F.lower(heading), F.lit(False)
    for phrase in UNSCHEDULED:
        marked = marked | text.contains(phrase)
    return F.when(marked, F.lit(False)).when(text.contains("meeting"), F.lit(True))


# What page chrome looks like, by the start of a line, whole lines, and a pattern.
CHROME_STARTS = (
    "Board of Governors of the Federal Reserve System",
    "The Federal Reserve, the central bank of the United States",
    "Skip to main content",
    "FRB: Press Release",
    "For media inquiries",
    "Last update:",
    "Implementation Note issued",
    "Share",
)
CHROME_LINES = (
    "home", "accessibility", "contact us", "press releases", "search", "submit", "site map", "a-z index", "home page",
    "news and", "events", "news and events", "monetary policy", "back to home", "share", "for immediate release",
    "skip to main content", "submit button",
)
CHROME_PATTERN = r"(?i)^\d{4}\s+monetary policy$"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# The shapes of document addresses, by era.
STATEMENT_URLS = (
    r"/fomc/(\d{8})default\.htm",
    r"/boarddocs/press/[a-z]+/\d{4}/(\d{8})/?(?:default\.htm)?$",
    r"/newsevents/press/monetary/(\d{8})[a-z]\d*\.htm",
    r"/newsevents/pressreleases/monetary(\d{8})[a-z]\d*\.htm",
)
MINUTES_URL = r"/monetarypolicy/fomcminutes(\d{8})\.htm"
MODERN_STATEMENT_URL = r"/newsevents/pressreleases/monetary(\d{8})a\.htm$"
URL_ERAS = (("fomc", "/fomc/"), ("boarddocs", "/boarddocs/"), ("press", "/press/monetary/"))


def clean_text(raw: Column) -> Column:
    """A page's text without chrome: white space in a line collapsed, empty lines and lines of chrome dropped."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), LINE_ENDS), lambda s: stripped(F.regexp_replace(s, r"(?U)\s+", " ")))

    def keep(line: Column) -> Column:
        bare = F.btrim(line, F.lit(" |"))
        chrome = F.lower(bare).isin(*CHROME_LINES) | bare.rlike(CHROME_PATTERN)
        for start in CHROME_STARTS:
            chrome = chrome | line.startswith(start)
        return (bare != "") & ~chrome

    return stripped(F.array_join(F.filter(lines, keep), "\n"))


def url_date(url: Column) -> Column:
    """The date in a document's address; null where no known shape matches, or the date is none."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (*STATEMENT_URLS, MINUTES_URL)]
    return F.to_date(F.try_to_timestamp(F.coalesce(*found), F.lit("yyyyMMdd")))


def url_host(url: Column) -> Column:
    """The host and port of an address, with any user before it; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_era(url: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, part in URL_ERAS:
        out = out.when(url.contains(part), name)
    return out.otherwise("pressreleases")


def raw_name(day: Column, url: Column) -> Column:
    """The file name of a raw document: its date and six digits of its address's hash."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), F.substring(F.sha2(url, 256), 1, 6), F.lit(".htm"))
