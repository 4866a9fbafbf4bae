"""Toxicity: ratios by hand, held-out accuracy, and the defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T

BAD = ["idiot", "moron", "clown", "pathetic"]


def corpus(n=400):
    rng, out = random.Random(6), []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.choice((20, 60, 400)))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
            words[rng.randrange(len(words))] = rng.choice(BAD)
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    odd = [(None, "you idiot", "x"), (9001, None, "x"), (9002, "", "x"), (9003, "idiot " * 40_000, "x"), (rows[0][0], rows[0][1], "x")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + odd, "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, 7), (None, 1), (6, rows[6][2])], "doc_id bigint, toxic int")
    got = T.scored(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score and 0 <= by[9001].score < 0.7 <= by[9003].score and all(r.predicted == (r.score >= 0.7) for r in got)
    again = {r.doc_id: r.score for r in T.scored(docs.repartition(7, "text"), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(6)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in T.scored(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 0) for i in range(6)], "doc_id bigint, toxic int")
    assert all(r.score < 0.5 for r in T.scored(docs, one).collect())
    assert T.scored(docs.limit(0), one).count() == 0


def test_counts_and_ratios(spark):
    rows = spark.createDataFrame([("abcabc", 0), ("abc", 1), ("xyz", 1)], "text string, toxic int")
    seen = np.zeros(1 << T.BITS, np.int32)
    found = {r.feature: (r.clean, r.toxic) for r in T.feature_counts(rows).collect()}
    assert found[T.TOTAL] == (1, 2)
    for text in ("abcabc", "abc", "xyz"):
        for f in T.features(text, seen).tolist():
            assert found[f] == tuple(sum(y == k and f in T.features(t, seen) for t, y in (("abcabc", 0), ("abc", 1), ("xyz", 1))) for k in (0, 1))
    pairs = spark.createDataFrame([(0, 400), (900, 10), (5, 2), (400, 200), (0, 0)], "clean long, toxic long")
    ratio = [r[0] for r in pairs.select(T.log_ratio(F.col("clean"), F.col("toxic"), [1000, 500])).collect()]
    assert ratio[0] > 3 and ratio[1] < -2 and ratio[2] == ratio[3] == ratio[4] == 0  # both signs; chance says nothing


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(50)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    picked = T.sampled(docs, marks, most=10, chars=500).groupBy("toxic").agg(F.count("*").alias("n")).collect()
    assert {r.toxic: r.n for r in picked} == {0: 5, 1: 5}


def test_one_long_text_does_not_end_the_sample(spark):
    rows = [(i, "clean words here " * 9 if i % 2 else "idiot words here " * 9) for i in range(60)] + [(100, "long " * 900_000), (101, "long " * 900_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, (i + 1) % 2) for i, _ in rows[:60]] + [(100, 1), (101, 0)], "doc_id bigint, toxic int")
    found = T.sampled(docs, marks, most=2000, chars=100_000).groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in found} == {0: 30, 1: 30}
    # With nothing that fits, the shortest is better than none.
    few = T.sampled(docs, marks, most=2000, chars=10).collect()
    assert len(few) == 2 and all(len(r.text) < 200 for r in few)
