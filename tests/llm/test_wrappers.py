"""Wrapper inference and extraction on hand-made layouts, and on the test pages by their own marks."""

import html
import os
import re
import time

import pytest

from tidemark.llm import wrappers as W

SF = "/root/testdata/sf0.001"


def page(i, kind):
    body = [f"Story {i} begins &amp; runs\n on, with words.", f"It ends {i * 7} steps on."]
    want = "  ".join(html.unescape(b) for b in body)
    menu = "<div class=menu><ul>" + "".join(f"<li><a href=x>Item {j}" for j in range(i % 3 + 2)) + "</ul></div>"
    if kind == "article":
        text = f"<header><h1>Site</h1></header><nav><a>Home</a></nav><article><p>{body[0]}<p>{body[1]}<div class='ad'>Buy {i}</div><section id=comments><p>Nice {i}</p></section></article><footer>&copy; {i}</footer>"
    else:
        text = f"<div class=cookie-notice>Accept {i}</div>{menu}<div class=wrap><div class=text><p>{body[0]}</p><p>{body[1]}</div><div class=side-bar>Also {i}</div></div><div>All rights reserved</div><form><p>Mail {i}</p></form>"
    return f"<html><head><title>T {i}</title><style>p>a{{}}</style><script>'</p>'+'<p>no'</script></head><body><!-- <p>no</p> -->{text}", " ".join(want.split())


def test_layouts(spark):
    rows, want = [], {}
    for i in range(24):
        kind = ("article", "plain")[i % 2]
        source, want[i] = page(i, kind)
        rows.append((i, f"http://{kind}.example/{i}", source, "x"))
    rows += [(90, None, None, "x"), (91, "no url", "", "x"), (92, "http://one.example/", "just a < b text", "x"), rows[3]]
    want |= {90: "", 91: "", 92: "just a < b text"}
    got = W.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_alignment_makes_groups_optional_or_repeated():
    whole = W.Wrapper()
    for slots in ("ab", "abbb", "acb", "acdcdb"):
        whole.align(W.Wrapper.of([(s, f"text {s}", 0) for s in slots]))
    shape = {tuple(g): (r, o) for g, r, o in whole.groups}
    assert shape[("a",)] == (False, False) and shape[("b",)] == (True, False)
    assert shape[("c",)] == (False, True) and shape[("c", "d")] == (True, True)


def texts(spark, sources):
    """The texts of the pages of one host, in their order."""
    rows = [(i, "http://host.example/", source) for i, source in enumerate(sources)]
    return [r.text for r in sorted(W.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())]


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_fields_that_vary_are_content_and_fixed_ones_template(spark):
    pages = [f"<body><p>Lead {words(i, 4)}</p><article><h4>Read this too</h4><p>{words(i, 30)}</p></article><p>One fixed line</p><section><p>Coda {i}</p></section>" for i in range(9)]
    assert texts(spark, pages) == [f"Lead {words(i, 4)} {words(i, 30)} Coda {i}" for i in range(9)]


def test_nothing_but_furniture_is_dropped(spark):
    lede = [f"<body><h1>Head {i}</h1><div class=lede>{words(i, 30)}</div><div class=text>{words(-i, 70)}</div>" for i in range(7)]
    assert texts(spark, lede) == [f"Head {i} {words(i, 30)} {words(-i, 70)}" for i in range(7)]
    two = [f"<body><div class=content><p>{words(i, 10)}</p></div><div class=entry><p>{words(-i, 90)}</p></div>" for i in range(7)]
    assert texts(spark, two) == [f"{words(i, 10)} {words(-i, 90)}" for i in range(7)]
    for name in ("has-sidebar", "no-sidebar", "layout-sidebar-right", "with-comments", "content-sidebar-wrap"):
        wrapped = [f"<body><div class='{name}'><h1>Head {i}</h1><div class=text>{words(i, 50)}</div></div><div class='site-footer'>Foot {i}</div><div class='x related-posts'><p>Also {i}</p></div>" for i in range(7)]
        assert texts(spark, wrapped) == [f"Head {i} {words(i, 50)}" for i in range(7)], name
    form = [f"<body><form id=all><nav>Menu {i}</nav><div class=post>{words(i, 9)}</div><div class=comments>{words(-i, 40)}</div></form>" for i in range(7)]
    assert texts(spark, form) == [words(i, 9) for i in range(7)]


def test_fixed_text_is_compared_whole_and_copies_count_once(spark):
    lead, body = f"Licence line {words(99, 40)}", f"Same {words(1, 80)}"
    page = "<body><h1>{}</h1><div class={}>{}</div><p>Fixed</p>".format
    assert texts(spark, [page(f"Head {i}", "text", f"{lead} then {words(i, 120)}") for i in range(7)]) == [f"Head {i} {lead} then {words(i, 120)}" for i in range(7)]
    others, want = [page(f"Head {i}", "text", words(i, 50)) for i in range(7)], [f"Head {i} {words(i, 50)}" for i in range(7)]
    assert texts(spark, [page("Same", "copy", body)] * 6 + others) == [f"Same {body}"] * 6 + want
    assert texts(spark, [page(f"On {i}", "copy", body) for i in range(7)] + others) == [f"On {i} {body}" for i in range(7)] + want


def test_empty_table(spark):
    assert W.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables")
def test_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in W.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<(?:/?p|br|/?h1)>", " ", re.sub("</?[bai](?: [^>]*)?>", "", inner))).split())


def test_runs_of_any_length_fold():
    slots = [f"s{i}" for i in range(40)]
    assert W.groups(["x", *slots * 3, "y"]) == [(("x",), False), (tuple(slots), True), (("y",), False)]
    assert W.groups(list("aabab")) == [(("a",), True), (("b",), False), (("a",), False), (("b",), False)]


def test_broken_markup_takes_linear_time():
    began = time.perf_counter()
    for piece in ("<a ", "<!", "<", "<p", '<a x="', "<!-- ", "<script>", "&amp", "</"):
        W.blocks(piece * 50_000)
        W.blocks("<p>" + piece * 50_000 + ">")
    assert time.perf_counter() - began < 20
    assert [b[1] for b in W.blocks("<p>one <!-- two > three")] == ["one"] == [b[1] for b in W.blocks("<p>one <script> two > three")]
    assert [b[1] for b in W.blocks("<p>1 < 2")] == ["1 < 2"]


def test_wrappers_do_not_depend_on_splits_and_decide(spark, monkeypatch):
    pages = [f"<body><p>Fixed line</p><div>{'<p>x</p>' * (i % 4)}<h2>H{i}</h2></div><p>{words(i, 20)}</p>{'<ul><li>a</li></ul>' * (i % 3)}" for i in range(40)]
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id bigint, host string, html string")
    assert W.wrappers(df.repartition(1)).collect() == W.wrappers(df.repartition(7, "page_id")).collect()
    before = texts(spark, pages)
    assert before[0] == f"H0 {words(0, 20)}"
    # Without the host's expression the fixed line can't be told from content.
    monkeypatch.setattr(W, "chosen", lambda found: found.selectExpr("host", "'[]' rules"))
    assert texts(spark, pages)[0] == f"Fixed line H0 {words(0, 20)}"


def test_large_rules_are_joined_by_shuffle(spark, monkeypatch):
    pages = [f"<body><p>Fixed line</p><p>{words(i, 20)}</p>" for i in range(7)]
    before = texts(spark, pages)
    monkeypatch.setattr(W, "BROADCAST_BYTES", -1)
    assert texts(spark, pages) == before


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    page = W.blocks("<div><p>t</p>" * 3000)
    assert len(page) == 3000 and sum(len(b[0]) for b in page) < 100_000
    assert not W.apart(page) and len(W.Wrapper.of(page).rows) == 3000
    assert not W.apart(W.blocks("<div class=ad>" * 3000 + "<p>only text</p>"))  # most of the text isn't furniture
    assert time.perf_counter() - began < 2


def test_unlike_pages_with_one_longest_line_and_copies(spark):
    """Pages are told apart by all their text, so a long notice on each is template; but a copied article isn't."""
    notice = "Copyright 2020 all rights reserved, whoever asks for them and whatever for, in all places."
    unlike = [f"<body><p>{words(i, 6)}</p><h2>{words(i + 50, 6)}</h2><ul><li>{words(i + 90, 12)}</ul><div>{notice}</div>" for i in range(8)]
    assert all("Copyright" not in t and words(i, 6) in t for i, t in enumerate(texts(spark, unlike)))
    copied = [f"<body><article><h1>{i}</h1><p>{words(1, 60)}</p><ul><li>{words(2, 30)}</ul></article>" for i in range(8)]
    assert texts(spark, copied) == [f"{i} {words(1, 60)} {words(2, 30)}" for i in range(8)]
