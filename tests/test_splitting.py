"""The trained splitter against a plain version of it, on texts with abbreviations."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.functions import text as T
from tidemark.operators import splitting as S

OPEN, CLOSE = "\"'([{“‘«", "\"')]}”’»"


def look(token):
    bare = token.lstrip(OPEN).rstrip(CLOSE)
    dot = bare.endswith(".")
    word = (bare[:-1] if dot else bare.rstrip(",;:!?")).lower()
    word = S.ELLIPSIS if bare.endswith("..") else S.NUMBER if re.fullmatch(r"-?[0-9]+([.,][0-9]+)*", word) else word
    first = bare[:1]
    return word, dot, "upper" if first != first.lower() else "lower" if first != first.upper() else "other", token == "" or dot or bare.endswith(("!", "?"))


def ll(k, n, p):
    part = lambda x, q: x * math.log(max(q, 1e-300)) if x > 0 else 0.0
    return part(k, p) + part(n - k, 1 - p)


def ratio(a, b, both, n):
    if both / a <= b / n:
        return 0.0
    rest = max(n - a, 1)
    return 2 * (ll(both, a, both / a) + ll(b - both, rest, (b - both) / rest) - ll(both, a, b / n) - ll(b - both, rest, b / n))


def trained(texts):
    """What decides whether a full stop between two tokens ends a sentence."""
    stream = []
    for text in texts:
        last = ""
        for token in (text or "").split():
            stream.append((look(last), look(token)))
            last = token
    n, dots, plain, form = len(stream), Counter(), Counter(), Counter()
    for b, a in stream:
        (dots if a[1] else plain)[a[0]] += 1
        form[a[0], a[2], b[3]] += 1
    p, short = sum(dots.values()) / n, set()
    for w, k in dots.items():
        if re.search(r"[^\W\d_]", w) and w not in (S.NUMBER, S.ELLIPSIS):
            size, m = len(w.replace(".", "")), plain[w]
            score = 2 * (ll(k, k + m, 0.99) - ll(k, k + m, p)) * math.exp(-size) * (len(w) - size + 1) / size**m
            if score >= S.ABBREVIATION:
                short.add(w)
    kind = lambda w: "number" if w == S.NUMBER else "abbreviation" if w == S.ELLIPSIS else "initial" if re.fullmatch(r"[^\W\d_]", w) else "abbreviation" if w in short else "word"
    every = lambda w: dots[w] + plain[w]
    after = Counter(a[0] for b, a in stream if b[3] and (not b[1] or kind(b[0]) == "word"))
    both = Counter((b[0], a[0]) for b, a in stream if b[1] and kind(b[0]) != "word")
    ends = sum(after.values())
    starter = {w for w, k in after.items() if re.match(r"[^\W\d_]", w) and ratio(ends, every(w), k, n) >= S.STARTER}
    bound = {(x, y) for (x, y), k in both.items() if k > 1 and ratio(dots[x], every(y), k, n) >= S.COLLOCATION}

    def ended(b, a):
        (x, kind_x), (y, _, f, _) = (b[0], kind(b[0])), a
        if not b[1] or kind_x == "word":
            return True
        if (x, y) in bound:
            return False
        small = form[y, "lower", True] + form[y, "lower", False]
        if kind_x == "abbreviation":
            return f == "upper" and ((small > 0 and not form[y, "upper", False]) or y in starter)
        inside = f == "lower" and (form[y, "upper", True] + form[y, "upper", False] > 0 or form[y, "lower", True] == 0)
        return not inside and not (kind_x == "initial" and f == "upper" and small == 0)

    return ended


def plainly(texts):
    ended, out = trained(texts), []
    for text in texts:
        parts, sentences, so_far = re.split(rf"(?<=[.!?])(?=\s)|(?<=[.!?][{re.escape(CLOSE)}])(?=\s)|(?<=[.!?][{re.escape(CLOSE)}]{{2}})(?=\s)|(?<=[.!?][{re.escape(CLOSE)}]{{3}})(?=\s)", (text or "").strip()), [], ""
        for i, part in enumerate(parts):
            so_far += part
            if i + 1 == len(parts) or ended(look(part.split()[-1]), look(parts[i + 1].split()[0])):
                sentences.append(so_far)
                so_far = ""
        out.append([x.strip() for s in sentences for x in s.split("\n") if len(x.strip()) >= T.LEAST_SENTENCE])
    return out


FED = "The U.S. Federal board met on Jan. 5 at 3 p.m. in Oslo. The vote of J. Smith was 2.5 to 1. It was \"close.\" Members, e.g. Dr. Jones, asked why! Then the board left... and the vote stood."


def texts():
    rng = random.Random(7)
    nouns, verbs = ["bank", "board", "rate", "vote", "market", "member"], ["rose", "fell", "met", "left", "stood"]
    out = [FED]
    for _ in range(120):
        s = [f"{rng.choice(['The', 'A', 'This'])} {rng.choice(nouns)} {rng.choice(verbs)}{rng.choice(['', ' in the U.S. market', ' by approx. 3 percent', ' as Dr. Jones said', ' on Jan. 5', ' at 3 p.m'])}{rng.choice(['.', '.', '!', '.)', '...'])}" for _ in range(rng.randint(1, 6))]
        out.append(rng.choice([" ", "\n", "  "]).join(s))
    return [*out, None, "", " \n ", "no stop here but long enough", FED, '"Quoted." (Closed.) "Open', "... ... 5. 6. a. b. C. D."]


def test_equals_plain_version(spark):
    all_ = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_)], "doc_id bigint, text string, word string").repartition(3)
    stops = S.inner_stops(S.pairs(docs).persist())
    rows = S.split(docs, stops).collect()
    got = {r.doc_id: r.sentences for r in rows}
    assert [got[i] for i in range(len(all_))] == plainly(all_) and rows[0].word == "x"
    assert any(s.startswith("The U.S. Federal board met on Jan. 5") for s in got[0]), got[0]
    assert T.LEAST_SENTENCE == 15 and got[121] == got[122] == got[123] == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, FED), (1, FED), (1, FED), (1, "Other text that is long. And more of that here."), (None, None)], "doc_id bigint, text string")
    rows = S.split(docs, S.inner_stops(S.pairs(docs))).collect()
    assert len(rows) == 5 and sorted(len(r.sentences) for r in rows)[:2] == [0, 2]
    assert S.split(docs.limit(0), S.inner_stops(S.pairs(docs.limit(0)))).count() == 0


@pytest.mark.parametrize("n", [30_000])
def test_long_texts_take_time_in_proportion(spark, n):
    docs = spark.createDataFrame([(1, "Dr. Who said 5. And left. " * n)], "doc_id bigint, text string")
    assert len(S.split(docs, S.inner_stops(S.pairs(docs))).first().sentences) >= 1


@pytest.mark.parametrize("sent", [0, S.SENT])
def test_few_and_many_stops(spark, sent):
    """Both ways give the same sentences; with few stops no text is shuffled."""
    odd = [" The U.S.\x1cFederal board met. \x1f", "He said (no.”) Then left it.)))) And so on.  ", "Jan. 5\x0bp.m. was late.\nThe bank, e.g. this, rose.\n\nShort. İ. Σ. Ünd so weiter und so fort. "]
    all_ = [*texts(), *odd]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_)], "doc_id bigint, text string, word string").repartition(3)
    stops = S.inner_stops(S.pairs(docs).persist())
    found = S.split(docs, stops, sent=sent)
    want = {r.doc_id: r.sentences for r in S.split_by_join(docs, stops, T.LEAST_SENTENCE, "doc_id", "text").collect()}
    assert {r.doc_id: r.sentences for r in found.collect()} == want and found.columns == ["doc_id", "text", "word", "sentences"]
    assert ("Exchange hashpartitioning" in found._jdf.queryExecution().toString()) == (sent == 0)


def test_counts_in_parts_equal_counts_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id bigint, text string").coalesce(1)
    whole = sorted(map(str, S.pairs(docs).collect()))
    monkeypatch.setattr(S, "HELD", 3)
    assert sum(r.n for r in S.tallied(docs, "text").collect()) == sum(len((t or "").split()) for t in texts())
    assert sorted(map(str, S.pairs(docs).collect())) == whole
