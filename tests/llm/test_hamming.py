"""Exact top-k search against all distances."""

import random

import numpy as np
import pytest

from tidemark.llm import hamming


@pytest.mark.parametrize(("n", "block", "part"), [(0, 50, 20), (4, 1 << 18, 1 << 10), (300, 1 << 18, 1 << 10), (300, 70, 20)])
def test_equals_brute_force(spark, n, block, part):
    rng = random.Random(n)
    base = [[rng.choice((-1.0, 1.0)) for _ in range(24)] for _ in range(12)]
    rows = [(i, [-x if rng.random() < 0.15 else x for x in rng.choice(base)], "x") for i in range(n)]
    rows += [(1000 + i, base[0], "x") for i in range(30 if n > 10 else 0)] + [(None, base[0], "x"), (2000, None, "x"), (2001, [1.0], "x")]
    df = spark.createDataFrame(rows + rows[:2], "vec_id bigint, embedding array<double>, code string")
    codes = hamming.codes(df, 24)
    got = {r.id: [tuple(x) for x in r.neighbours] for r in hamming.nearest(codes, codes.filter("id % 5 = 0"), 10, 24, block, part).collect()}
    have = {i: [x > 0 for x in v] for i, v, _ in rows if i is not None and v and len(v) == 24}
    want = {i: [(j, d) for d, j in sorted((sum(a != b for a, b in zip(v, w, strict=True)), j) for j, w in have.items() if j != i)[:10]] for i, v in have.items() if i % 5 == 0}
    assert got == want


@pytest.mark.parametrize("bits", [64, 100])
def test_segments_find_the_nearest(bits):
    rng = np.random.default_rng(bits)
    bit = rng.integers(0, 2, (700, bits), dtype=np.uint64)
    bit[300:] = bit[rng.integers(0, 300, 400)] ^ (rng.random((400, bits)) < 0.1)
    words = np.zeros((700, -(-bits // 64)), np.uint64)
    for i in range(bits):
        words[:, i // 64] |= bit[:, i] << np.uint64(i % 64)
    words = np.unique(words, axis=0)
    ids = rng.permutation(len(words))
    q, code, distance = hamming.Segments(words, bits).nearest(words[:40], ids, 9)
    every = np.bitwise_count(words[:40, None] ^ words[None]).sum(axis=2)
    for i in range(40):
        order = np.lexsort((ids, every[i]))[:9]
        assert code[q == i].tolist() == order.tolist() and distance[q == i].tolist() == every[i][order].tolist()
