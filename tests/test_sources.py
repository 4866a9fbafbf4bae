"""Page parsing, stage tables and the manifest."""

import hashlib
import time
from datetime import date

import pytest

from tidemark.sources import html, stages
from tidemark.sources import html as html_

LONG = "The Committee decided to keep the target. " * 12


@pytest.mark.parametrize(
    ("page", "selector"),
    [
        (f"<nav>Menu</nav><div id=content><p>{LONG}</p></div><div id='article' class='x'><p>{LONG}<script>no</script></p></div>", "div#article"),
        (f"<div class='col-md-8 col-xs-12 col-sm-8'>{LONG}</div>", "div.col-xs-12.col-sm-8.col-md-8"),
        (f"<div id=article>short</div><td class='a text'>{LONG}", "td.text"),
        (f"<body><header>Top</header>{LONG}<footer>End</footer>", html.WHOLE_PAGE),
        ("", html.WHOLE_PAGE),
        (None, html.WHOLE_PAGE),
    ],
)
def test_bodies(spark, page, selector):
    got = html.bodies(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert got.selector_used == selector and got.text == (LONG.strip() if page else "")


def test_unclosed_markup_is_linear():
    assert len(html.page_links("<a href=x " * 20000, None)) <= 1
    assert html.body_candidates("<div>" * 5000)[-1] == (html.WHOLE_PAGE, "")


def test_parsing_takes_time_in_proportion():
    def took(html):
        began = time.process_time()
        html_.body_candidates(html)
        html_.page_links(html, "http://x/")
        return time.process_time() - began

    for unit in ("<p><a href=x>t</a>", "<script>a</script><p>t", "<div>t</p>", "<a href=x>t", "<div class=fomc-meeting><a href=x>t</a>", "<h4>t<a href=x>t</a>", "<ul><li>t</ul>"):
        took(unit * 500)
        few, many = took(unit * 2000), took(unit * 8000)
        assert many < 10 * few + 0.2, (unit, few, many)


def test_links_do_not_nest():
    got = html_.page_links("<h3>One</h3><p><a href=a>x<a href=b>y</p><h5>Two</h5><div><a href=c>z</a></div>", "http://x/")
    assert [(r["href"], r["text"], r["heading"]) for r in got] == [("a", "x", "One"), ("b", "y", "One"), ("c", "z", "Two")]


INDEX = """<h4>January Meeting - 2003</h4><div><p><a href="/boarddocs/press/monetary/2003/20030129/default.htm">Statement</a>
<a href="/other.htm">Statement</a></p></div><h5>March (unscheduled)</h5><div><p><a href="/newsevents/press/monetary/20080318a.htm"> Statement </a>
<a href="/monetarypolicy/fomcminutes20080318.htm">Minutes</a></p></div>"""
CALENDAR = """<div class="row fomc-meeting"><div>January 27-28 <a href="/newsevents/pressreleases/monetary20260128a.htm">HTML</a><a href="/newsevents/pressreleases/monetary20260128a1.htm">Note</a></div></div>
<p><a href="/newsevents/pressreleases/monetary20250822a.htm">Statement on Goals</a></p><div class="fomc-meeting--x">(notation vote) <a href="/newsevents/pressreleases/monetary20260301a.htm">HTML</a></div>"""


def test_discovery(spark):
    pages = spark.createDataFrame([(1, "https://x.gov/a/", INDEX)], "page_id int, url string, html string")
    got = [(r.doc_type, r.doc_date, r.url, r.is_scheduled) for r in html.discovered(html.links(pages), False).orderBy("doc_date", "doc_type").collect()]
    assert got == [
        ("statement", date(2003, 1, 29), "https://x.gov/boarddocs/press/monetary/2003/20030129/default.htm", True),
        ("minutes", date(2008, 3, 18), "https://x.gov/monetarypolicy/fomcminutes20080318.htm", False),
        ("statement", date(2008, 3, 18), "https://x.gov/newsevents/press/monetary/20080318a.htm", False),
    ]
    calendar = spark.createDataFrame([(1, "https://x.gov/a/", CALENDAR)], "page_id int, url string, html string")
    got = [(r.doc_date, r.is_scheduled) for r in html.discovered(html.links(calendar), True).orderBy("doc_date").collect()]
    assert got == [(date(2026, 1, 28), True), (date(2026, 3, 1), False)]


def test_manifest_and_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name in ("a", "b"):
        (raw / name).write_bytes(name.encode() * 9)
    digest = lambda name: hashlib.sha256(name.encode() * 9).hexdigest()
    rows = [("u1", "a", 200, 9, digest("a"), None), ("u2", "b", 200, 9, "0", None), ("u3", "c", 200, 9, digest("c"), None), ("u4", "d", 404, 0, None, None)]
    path = str(tmp_path / "manifest")
    assert stages.read(spark, "manifest", path).count() == 0
    stages.write(spark.createDataFrame(rows, stages.schema("manifest")), "manifest", path, "url")
    manifest = stages.read(spark, "manifest", path)
    assert sorted(map(tuple, stages.verified(manifest, stages.raw_files(spark, str(raw))).collect())) == [("b", "sha256_mismatch"), ("c", "file_missing")]
    wanted = spark.createDataFrame([("u1",), ("u9",)], "url string")
    assert [r.url for r in stages.not_fetched(wanted, manifest).collect()] == ["u9"]
    assert stages.appended(manifest, manifest.limit(1)).count() == 5


@pytest.mark.parametrize("table", sorted(stages.SCHEMAS))
def test_stage_tables_keep_their_schema(spark, tmp_path, table):
    path = str(tmp_path / table)
    stages.write(spark.createDataFrame([tuple(None for _ in stages.schema(table))], stages.schema(table)), table, path)
    got = stages.read(spark, table, path)
    assert got.schema.simpleString() == stages.schema(table).simpleString() and got.count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        stages.write(got, table, path)


def test_first_of_each_key(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 7)], "url string, n int")
    assert sorted((r.n) for r in stages.first_of(rows, "url", "n").collect()) == [1, 4, 7]
