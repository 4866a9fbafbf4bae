"""BPE against the public library, and exact round trips."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    rng = random.Random(4)
    odd = ["", " ", "\n\n  x", "don't we'll I'VE", "naïve Straße 東京 🙂👍🏽", "a b　c\x1cd", "1234567 ½ ٣", "<|endoftext|> and <|endoftext|>", "x" * 3000, " " * 500, "ab" * 2000, "퟿\U0010ffff"]
    return odd + ["".join(rng.choice("aeinst  thé.,'\n09东🙂") for _ in range(rng.randrange(80))) for _ in range(300)]


def test_ids_and_decoded_text_equal_the_library(spark, library):
    rows = [*enumerate(texts()), (None, None), (0, texts()[3])]
    got = bpe.encoded(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string"), tokenizer_path()).collect()
    key = lambda r: (str(r[0]), r[1])
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_a_very_long_text_round_trips(library):
    text = "The quick brown fox — jumps over 13 lazy dogs!\n" * 20_000
    words = bpe.vocabulary(tokenizer_path())
    ids = words.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids and words.decode(ids) == text


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path()).count() == 0
