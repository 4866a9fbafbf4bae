"""The defined cases of every operator on documents: nulls, empty and very long texts, repeated rows, clashing columns."""

import pytest

from tidemark.llm import bagminhash, bpe, decontaminate, hamming, ppm, repeats, secrets, toxicity, warc, wrappers
from tidemark.llm.queries import tokenizer_path

#: Names that the operators use inside.
CLASHES = ["text_hash", "row", "key", "node", "label", "band", "bands", "hash", "id", "n", "start", "path", "spans", "found", "base", "held_out", "score", "cost", "w", "hit", "items", "gram_hash", "kept_id", "bad_id", "copies", "html_", "toxicity", "toxic", "ids"]
LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(120_000))
TEXTS = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "null id here"), (None, None), (7, "é" * 70_000), (8, "password = abcdefgh12"), (9, "a b c d e f g h i j k l")]


@pytest.fixture(scope="module")
def docs(spark):
    names = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in TEXTS], f"doc_id bigint, text string, {names}").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j", "x"), (2, None, "x"), (3, "", None)], "item_id bigint, text string, gram string")


def by_id(df):
    rows = df.collect()
    assert len(rows) == len(TEXTS) and sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    return {r.doc_id: r for r in rows}


def test_repeats(docs):
    got = by_id(repeats.cut(docs))
    assert got[5].n_words == 120_000 == got[5].n_removed == got[6].n_removed and got[1].n_words == got[3].n_words == 0


def test_bagminhash(docs):
    got = by_id(bagminhash.classes(docs))
    assert got[5].class_id == got[6].class_id == 5 and got[5].n_members == 3 and got[4].n_members == 1 and got[1].class_id == got[2].class_id
    kept = bagminhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(str, [3, 4, 5, 7, 8, 9, None, None]))


def test_decontamination(docs, items):
    got = by_id(decontaminate.report(docs, items))
    assert got[9].n_hit == 10 and got[9].contaminated and not got[5].contaminated and got[5].n_words == 120_000
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 1
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == len(TEXTS)


def test_secrets(docs):
    got = by_id(secrets.scanned(docs))
    assert got[8].n_assign == 1 and got[8].spans == "assign:0:21" and got[1].spans == got[2].spans == got[7].spans == ""
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.filter("doc_id = 8 or doc_id = 1").collect()} == {"[secret]", None}


def test_ppm(docs):
    got = by_id(ppm.scored(docs, 3))
    assert got[5].n_tokens == 120_001 and got[5].score == got[6].score < 0 and got[1].n_tokens == got[2].n_tokens == 1


def test_bpe(docs):
    got = by_id(bpe.encoded(docs, tokenizer_path()))
    assert got[5].decoded == LONG and got[1].n_tokens == got[2].n_tokens == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(3, 9)], "doc_id bigint, toxic int, text string")
    assert all(0 <= r.score <= 1 for r in by_id(toxicity.scored(docs, labels)).values())


def test_pages(spark):
    names = ["host", "slot", "digest", "refers_to", "range", "place", "wrapper", "rules"]
    rows = [(1, "http://a/", None), (2, None, "<p>x"), (2, None, "<p>x"), (3, "::bad::", "<article>" + "<p>word</p>" * 20_000), (None, "http://a/", "")]
    pages = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in names))
    got = {r.page_id: r for r in wrappers.extracted(pages).collect()}
    assert got[3].n_chars == 20_000 * 5 - 1 and got[1].text == got[None].text == "" and got[2].text == "x"
    read = warc.read(spark, *warc.write(pages)).collect()
    assert sorted(str(r.page_id) for r in read) == sorted(str(r[0]) for r in rows)


def test_vectors(spark):
    rows = [(1, [1.0] * 64, "x"), (2, [1.0] * 64, "x"), (2, [1.0] * 64, "x"), (3, [float("nan")] * 64, "x"), (4, None, "x"), (None, [1.0] * 64, "x"), (20, [-1.0] * 64, "x")]
    codes = hamming.codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string"))
    got = {r.id: [tuple(n) for n in r.neighbours] for r in hamming.nearest(codes, codes).collect()}
    assert got == {1: [(2, 0), (3, 64), (20, 64)], 2: [(1, 0), (3, 64), (20, 64)], 3: [(20, 0), (1, 64), (2, 64)], 20: [(3, 0), (1, 64), (2, 64)]}
    assert hamming.nearest(codes.limit(0), codes.limit(0)).count() == 0
