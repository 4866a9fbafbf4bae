"""Substring dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import repeats


def brute(texts, window=35):
    words = [(t or "").split() for t in texts]
    grams = [[tuple(w[i : i + window]) for i in range(len(w) - window + 1)] for w in words]
    count = Counter(g for each in grams for g in each)
    for w, each in zip(words, grams, strict=True):
        hit = {i + j for i, g in enumerate(each) if count[g] > 1 for j in range(window)}
        yield len(w), len(hit), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in hit).encode()).hexdigest()


@pytest.mark.parametrize("bits", [64, 2])
def test_equals_brute_force(spark, bits):
    """With hashes of two bits most groups are of unlike words, and are told apart by the words themselves."""
    rng = random.Random(5)
    make = lambda n, v=400: [f"é{rng.randrange(v)}" for _ in range(n)]
    shared, texts = [make(n) for n in (34, 35, 36, 80, 300)], [None, "", "one two", "a " * 34, "a " * 35, "b " * 36, "c d e " * 30]
    for i in range(60):
        parts = [make(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:] if i % 2 else p, make(rng.randrange(0, 40), 3 if i % 7 == 0 else 400)]
        texts.append("\n".join(" ".join(p) for p in parts))
    texts += texts[10:20] + texts[12:13] * 30
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(11, texts[11], "y")]
    got = repeats.cut(spark.createDataFrame(rows, "doc_id bigint, text string, key string"), bits=bits).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_removed for r in got) and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert all(sum(b - a + 1 for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed for r in got)


def test_empty_table(spark):
    assert repeats.cut(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_paths_compact_across_seeds(spark):
    """A passage of 400 words that two texts share whole is one span, though it has many seeds."""
    rng = random.Random(3)
    make = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    passage = make(400)
    docs = repeats.keyed(spark.createDataFrame([(1, f"{make(50)} {passage} {make(60)}"), (2, f"{make(7)}\n{passage}\t{make(90)}"), (3, make(300))], "doc_id bigint, text string"))
    seeds = repeats.paths(docs, 35, 12).groupBy("key").count().filter("count > 1").count()
    spans = sorted((r.doc_id, r.start, r.n) for r in repeats.repeated_spans(docs).collect())
    longest = {i: max(n for d, _, n in spans if d == i) for i in (1, 2)}
    assert seeds > 20 and len(spans) < 30 and all(n > 300 for n in longest.values())
    for i, first in ((1, 50), (2, 7)):
        assert {s + k for d, s, n in spans if d == i for k in range(n)} == set(range(first, first + 366))
