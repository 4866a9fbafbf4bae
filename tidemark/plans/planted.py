"""The documents and page addresses of the queries, with the marks that the event-study operators look for.

The given texts are invented words and hold none of them, so each kind is put into some of the rows, by id: a stated
release time, an error page, words on the schedule, lines of page chrome and a boilerplate sentence; addresses get the
shapes of each era. ``TEXTS`` and ``PAGES`` are the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOTE = " Voting for the monetary policy action were all members. Voting against the action was nobody."
CHROME = "Skip to main content\nHome |\n2007 Monetary Policy\nLast update: today\n"
#: Starts of addresses by era, whose date follows, and what ends them.
SHAPES = (("/fomc/", "default.htm"), ("/boarddocs/press/monetary/2000/", "/default.htm"), ("/newsevents/press/monetary/", "a1.htm"), ("/newsevents/pressreleases/monetary", "b.htm"), ("/monetarypolicy/fomcminutes", ".htm"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text``."""
    i = F.col("doc_id")
    mark = lambda rest, of, text: F.when(i % of == rest, text).otherwise("")
    time = F.concat(F.lit("For release at "), i % 14, F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.when(i % 4 == 0, " a.m.").otherwise(" p.m."), F.lit(" EST\n"))
    heading = F.when(i % 12 == 5, "Conference call of the meeting\n").when(i % 4 == 1, "Statement after the meeting\n").when(i % 12 == 6, "Unscheduled statement\n").otherwise("")
    lead = F.concat(mark(1, 10, "Page not found\n"), mark(0, 6, time), heading, mark(3, 7, CHROME))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.when(F.col("text").isNotNull(), F.concat(lead, F.col("text"), mark(2, 5, VOTE))).alias("text"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, url, html``."""
    i, url = F.col("page_id"), F.when(F.lit(False), "")
    day = F.date_format(F.date_add(F.lit("1996-01-31").cast("date"), (i * 17 % 5000).cast("int")), "yyyyMMdd")
    for k, (start, end) in enumerate(SHAPES):
        # Of each shape some have a date that is none.
        url = url.when(i % 8 == k, F.concat(F.lit(f"http://www.example.org{start}"), F.when(i % 56 == k, "20011340").otherwise(day), F.lit(end)))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", url.otherwise(F.col("url")).alias("url"), "html")


_CHROME = CHROME.replace("\n", "' || chr(10) || '")
TEXTS = f"""pd AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'Page not found' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN 'For release at ' || doc_id % 14 || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 4 = 0 THEN ' a.m.' ELSE ' p.m.' END || ' EST' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 12 = 5 THEN 'Conference call of the meeting' || chr(10) WHEN doc_id % 4 = 1 THEN 'Statement after the meeting' || chr(10) WHEN doc_id % 12 = 6 THEN 'Unscheduled statement' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 7 = 3 THEN '{_CHROME}' ELSE '' END || text || CASE WHEN doc_id % 5 = 2 THEN '{VOTE}' ELSE '' END AS text FROM documents)"""
_DAY = "CASE WHEN page_id % 56 = {k} THEN '20011340' ELSE strftime(DATE '1996-01-31' + CAST(page_id * 17 % 5000 AS INTEGER), '%Y%m%d') END"
PAGES = f"""pp AS (SELECT page_id, html, CASE {" ".join(f"WHEN page_id % 8 = {k} THEN 'http://www.example.org{start}' || {_DAY.format(k=k)} || '{end}'" for k, (start, end) in enumerate(SHAPES))} ELSE url END AS url FROM pages)"""


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, html``: the documents as pages, their texts where the selectors of several eras look for them, with
    menus, scripts and footers around and inside."""
    text = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    body = F.concat(F.lit("<p>"), text, F.lit("</p>"))
    i = F.col("doc_id")
    page = F.when(i % 5 == 0, F.concat(F.lit("<nav>Menu <b>x</b></nav><div id=content>Old</div><div class='x' id='article'><style>p {}</style>"), body, F.lit("<script>if (a < b) {}</script></div><footer>End</footer>")))
    page = page.when(i % 5 == 1, F.concat(F.lit("<table><tr><td class='b text'>"), body, F.lit("<nav>More</td></table>")))
    page = page.when(i % 5 == 2, F.concat(F.lit("<header><div id=article>No</div></header><div class='col-md-8 col-xs-12 col-sm-8'>"), body, F.lit("<header>Top<br></header></div>")))
    page = page.when(i % 5 == 3, F.concat(F.lit("<div id='article'>Short.</div><div id='leftText'>"), body, F.lit("</div>")))
    return texts(spark, sf).select("doc_id", page.otherwise(F.concat(F.lit("<body><header>Top</header>"), body, F.lit("<footer>End</footer>"))).alias("html"))


def index_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, url, html``: an index page of a year for each page, of meetings whose dates follow from its id."""
    i = F.col("page_id")
    day = lambda plus: F.date_format(F.date_add(F.lit("1994-02-01").cast("date"), (i * 3 % 4000 + plus).cast("int")), "yyyyMMdd")
    html = F.concat(
        F.lit("<nav><a href=/home.htm>Home</a></nav><h4>Meeting no. "), i, F.lit(" of the year</h4><div><p><a href='/fomc/"), day(0), F.lit("default.htm'>Statement</a> <a href='/fomc/"), day(0), F.lit("default.htm'>Text</a> <a href=/other.htm>Statement</a></p></div><h5>"),
        F.when(i % 3 == 0, "Conference call").when(i % 3 == 1, "Second meeting").otherwise("Later"), F.lit("</h5><div><ul><li><a href=/newsevents/press/monetary/"), day(30), F.lit("a.htm> Statement </a><li><a href='../monetarypolicy/fomcminutes"), day(30), F.lit(".htm'>Minutes &amp; more</a><li><a href=/fomc/20011340default.htm>Statement</a></ul></div>"),
    )
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.lit("http://www.example.org/years/"), i, F.lit(".htm")).alias("url"), html.alias("html"))
