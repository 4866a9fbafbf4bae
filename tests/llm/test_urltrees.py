"""URL templates: the rules, planted branches, and the whole query against its SQL."""

import os
import random

import duckdb
import pytest

from tidemark.llm import urltrees
from tidemark.llm.queries import OP11_SQL, RULES, op11_urls

SF = "/root/testdata/sf0.01"


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def test_parts_and_rules(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2#/es/", "x://org/", "http://org?/es/", "http://my.com/fr/", "http://mycom/fr/", "http://a.com/de/1", "http://notexample.org/es/1", None, "no scheme/", "a://b://c/d", "http://x.org:80/es/", ""]
    got = [(r.host, r.path, r.rule, r.ruling) for r in urltrees.ruled(urltrees.parsed(pages(spark, urls)), RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("org", "/", "org/", "allow"), ("org", "", None, None),
        ("my.com", "/fr/", "com/fr/", "allow"), ("mycom", "/fr/", None, None), ("a.com", "/de/1", "com/de/", "block"), ("notexample.org", "/es/1", "org/", "allow"), ("", "", None, None), ("", "", None, None), ("b:", "//c/d", None, None), ("x.org:80", "/es/", None, None), ("", "", None, None),
    ]


def planted():
    rng = random.Random(1)
    urls = [f"http://shop.example.com/de/item/{i}" for i in range(60)] + [f"http://shop.example.com/fr/item/{i}.html" for i in range(40)]
    urls += [f"http://shop.example.com/{x}/item/{i}" for x in ("en", "es") for i in range(30)]
    urls += [f"http://shop.example.com/{''.join(rng.choices('abcdefgh', k=9))}" for i in range(50)]
    # Nearly all that is known of this host is blocked, so its other branch goes too.
    urls += [f"http://bad.com/de/{i}" for i in range(80)] + [f"http://bad.com/offers/{i}" for i in range(20)]
    urls += [f"http://new.net/a/ab{i:030x}" for i in range(20)] + ["http://new.net/one-of-the-slugs/x2y", "http://new.net/", "http://new.net"]
    return urls


def test_planted_branches(spark):
    got = {}
    for r in urltrees.judged(pages(spark, planted()), RULES).collect():
        got.setdefault((r.host, r.template, r.verdict), []).append(r)
    counts = {k: len(v) for k, v in got.items()}
    assert counts[("shop.example.com", "/de/item/{n}", "block")] == 60 and counts[("shop.example.com", "/fr/item/{n}.html", "allow")] == 40
    assert counts[("shop.example.com", "/en|es/item/{n}", "allow")] == 60 and counts[("shop.example.com", "/*", "allow")] == 50
    assert counts[("bad.com", "/offers/{n}", "block")] == 20 and counts[("new.net", "/a/{x}", "allow")] == 20
    assert sum(counts.values()) == len(planted())


def compare(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet{'/*.parquet' if os.path.isdir(f'{folder}/pages.parquet') else ''}')")
    want = con.execute(OP11_SQL)
    names = [d[0] for d in want.description]
    rows = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in op11_urls(spark, folder).select(*names).collect()) == rows
    return len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables")
def test_query_equals_sql(spark):
    assert compare(spark, SF) == 250


def test_planted_and_odd_urls_equal_sql(spark, tmp_path):
    odd = [None, "", "x", "://", "http://h//a//", "http://h/" + "a/" * 3000, "http://h/{n}/*|-", "http://h/" + "é" * 5000, "http://h/1.html/2", "http://h/1.html/2"]
    rows = [(i, u, "c", "c") for i, u in enumerate([*planted(), *odd])] + [(None, "http://h/1", "c", "c")]
    spark.createDataFrame(rows, "page_id bigint, url string, host string, shape string").write.parquet(f"{tmp_path}/pages.parquet")
    assert compare(spark, tmp_path) == len(rows)


def test_empty(spark):
    assert urltrees.judged(pages(spark, ["a"]).limit(0), RULES).count() == 0
