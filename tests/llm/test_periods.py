"""Periodic runs against all stretches tried one by one."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import periods
from tidemark.llm.queries import op12_periods


def brute(words, least, times):
    """Every period and start: extend to the right, keep what the word before doesn't extend, smallest periods only."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                smaller = any(q % d == 0 and all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
                if not smaller:
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def made(rng):
    kind, letters = rng.randrange(5), [b"a", b"b", b"c", "é".encode()]
    if kind == 0:
        return [rng.choice(letters[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
    if kind == 1:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        return [rng.choice(letters) for _ in range(rng.randint(0, 9))] + unit * rng.randint(1, 12) + unit[: rng.randint(0, len(unit))]
    if kind == 2:
        inner = [b"a"] * rng.randint(1, 5) + [b"b"]
        return (inner * rng.randint(2, 6) + [b"c"]) * rng.randint(1, 7)
    if kind == 3:
        a, b = [b"a"], [b"a", b"b"]
        for _ in range(rng.randint(1, 7)):
            a, b = b, b + a
        return b
    return [b"x"] * rng.randint(0, 90)


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    docs = [made(rng) for _ in range(150)]
    assert periods.runs_of(docs, least, times) == [brute(d, least, times) for d in docs]


def test_long_texts_of_one_word_and_of_long_periods():
    unit = [b"%d" % (i * i % 1009) for i in range(5000)]
    got = periods.runs_of([[b"w"] * 200_000, unit * 5, []], 6, 4)
    assert got[0] == [(0, 200_000, 1)] and (0, 25_000, 1009) not in got[1] and got[2] == []
    assert got[1] == brute_long(unit * 5)


def brute_long(words):
    """The periods that divide the whole or come from the squares' own period."""
    out = []
    for q in (1009, 5000):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= 4 * q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out)


def looped(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: " \n\t".join(w.decode() for w in made(rng)) for i in range(400)}
    texts |= {900: None, 901: "", 902: " \x0b ", 903: "a\x1cb c " * 9, 904: "x y " * 20, 905: "x y " * 20}
    spark.createDataFrame([(t, i, "c") for i, t in texts.items()], "text string, doc_id bigint, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_periods(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    n_looped = 0
    for i, text in texts.items():
        plain = (text or "").encode().split()
        words = looped(plain, i)
        n_looped += words != plain
        runs = brute(words, 6, 4)
        covered = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = None
        for s, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want, i
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode())
        assert r.collapsed_sha256 == sha(b" ".join(w for j, w in enumerate(words) if j not in covered))
    assert n_looped > 15


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "b b b b b b b", "x"), (2, "a", "x"), (2, "a", "x")], "doc_id bigint, text string, n_words string")
    got = sorted((str(r.doc_id), r.n_words, len(r.runs), r.collapsed) for r in periods.found(docs).collect())
    assert got == [("1", 0, 0, ""), ("2", 1, 0, "a"), ("2", 1, 0, "a"), ("None", 7, 1, "b")]
    assert periods.found(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.found(docs, least=1)
