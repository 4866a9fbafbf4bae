"""BagMinHash classes against brute force, and the estimate against the exact similarity."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bagminhash as B
from tidemark.llm import tokens
from tidemark.llm.stage import small_batches


def jaccard(a, b):
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (a.split(), b.split())]
    return sum((bags[0] & bags[1]).values()) / max(1, sum((bags[0] | bags[1]).values()))


def texts():
    rng, out = random.Random(1), [None, "", "one", "one", "one  two three", "line again and again now " * 50, "line again and again now " * 55, "line again and again now " * 9]
    for _ in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((30, 200, 900)))]
        out.append(" ".join(words))
        for share in (0.01, 0.02, 0.06):
            out.append(" ".join(f"x{rng.randrange(900)}" if rng.random() < share else w for w in words))
    return out + out[20:24]


def kin():
    """Pairs of near copies whose bases are alike, but less than the threshold: buckets of many classes."""
    rng, base = random.Random(8), [f"b{i}" for i in range(300)]
    for _ in range(25):
        words = [f"y{rng.randrange(9999)}" if rng.random() < 0.03 else w for w in base]
        yield " ".join(words)
        words[rng.randrange(300)] = "z"
        yield " ".join(words)


@pytest.mark.parametrize("make", [texts, kin])
def test_classes_equal_brute_force(spark, make):
    rows = list(enumerate(make()))
    got = {r.doc_id: r.class_id for r in B.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[i + 1 :]:
            if (a or "") == (b or "") or jaccard(a or "", b or "") >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert got == label
    kept = B.representatives(spark.createDataFrame([*rows, rows[9], rows[9]], "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(label.values()))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 40, (2, 300))
    hashes = rng.integers(0, 2**63, 300).astype(np.uint64)
    row = np.repeat([0, 1], counts.sum(axis=1))
    s = B.signatures(row, np.concatenate([np.repeat(hashes, c) for c in counts]), 2, places=4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(*counts).sum() / np.maximum(*counts).sum()) < 0.03


def test_empty_table(spark):
    assert B.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_bounded_memory(spark):
    """A task takes texts by small batches and slices, so that its temporary arrays stay small; the session's own
    batches stay as they were."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(9999)}" for _ in range(2_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 900 : i % 900 + 300])) for i in range(3_000)], "doc_id bigint, text string").coalesce(1)

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(b.num_rows for b in batches)]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark):
        assert docs.mapInArrow(largest, "n bigint").first().n <= 1000
    assert spark.conf.get(name) == before
    batch = docs.select("text").toArrow().combine_chunks().to_batches()[0]
    tracemalloc.start()
    for part in tokens.slices(batch, "text", B.SLICE_BYTES):
        B.signatures(*B.shingles(*tokens.raw(part.column("text"))), part.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, batch.column("text").to_pylist())) > 4e6 and peak < 48e6, peak
