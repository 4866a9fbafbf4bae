"""Language-model scores against a trie walked byte by byte, with all, some or none of the costs broadcast."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import ppm


def brute(rows, order):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    split = [(t or "").encode().lower().split() for _, t in rows]
    words, trie = Counter(), defaultdict(Counter)
    streams = [b"\n" * order + b"".join(b" " + w for w in each) + b"\n" for each in split]
    for h, each, s in zip(held, split, streams, strict=True):
        if not h:
            words.update([*each, None])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    trie[s[i - k : i]][s[i]] += 1
    n, v = sum(words.values()), len(words)
    for (i, _), h, each, s in zip(rows, held, split, streams, strict=True):
        score = 0.0
        for j in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                at = {b: c for b, c in trie[s[j - k : j]].items() if b not in gone}
                total = sum(at.values()) + len(at)
                if s[j] in at:
                    score += math.log10(at[s[j]] / total)
                    break
                if at:
                    score += math.log10(len(at) / total)
                gone |= set(at)
            else:
                score -= math.log10(256 - len(gone))
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*each, None])
        yield i, h, len(each) + 1, sum(words[w] > 0 for w in [*each, None]), n, base, score


@pytest.mark.parametrize("most", [ppm.BROADCAST_ROWS, 40, 0])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(ppm, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    rows = [(i if i else None, rng.choice(["", " ", "\n"]).join(rng.choice(["Abra ", "cad", "é ", "abra\t", "x", f"{i} "]) for _ in range(rng.randrange(30)))) for i in range(30)]
    rows += [(50, None), (51, ""), (7, rows[7][1]), (7, rows[7][1])]
    got = ppm.scored(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int"), 3).collect()
    key = lambda r: (str(r[0]), r[2], r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, 3), key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_nothing_to_learn_from(spark):
    assert ppm.scored(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = ppm.scored(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).first()
    assert (got.n_known, got.train_tokens) == (0, 0) and got.score == pytest.approx(-4 * math.log10(256))
