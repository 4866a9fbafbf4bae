"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is exactly one token that its encoding ends with. The automaton
over the vocabulary lists the tokens that end at each place; a token is the last one of a prefix iff
the pair (last token of the shorter prefix, this token) is compatible: encoding the two tokens'
bytes together gives the two tokens back. Back-pointers from the end yield the ids, equal to those
of merging by rank.

Null texts are empty texts: no ids, empty decoded text. Texts of any length are encoded whole, in
linear time; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Distinct pieces whose ids a Python worker keeps; when full, it starts anew.
CACHE_PIECES = 1_000_000
#: Distinct token pairs whose compatibility a worker keeps.
CACHE_PAIRS = 1_000_000
#: A piece longer than this is encoded but not cached.
CACHE_CHARS = 64


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


#: Characters beyond the first plane; texts without them are split by a class that is one table look-up.
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def unicode_class(name: str, top: int) -> str:
    """The characters of a Unicode property up to ``top`` as ranges for a class of the faster ``re`` module."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, top + 1))))
    runs = (m.group() for m in regex.finditer(rf"\p{{{name}}}+", every))
    return "".join(re.escape(r[0]) + ("-" + re.escape(r[-1]) if len(r) > 1 else "") for r in runs)


def piece_pattern(top: int) -> re.Pattern:
    letter, number = unicode_class("L", top), unicode_class("N", top)
    space = "".join(re.escape(c) for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """A tokenizer file's tokens, ranks and special strings, with the pair test and its caches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        model = spec["model"]
        self.token = {i: b"".join(map(back.__getitem__, t)) for t, i in model["vocab"].items() if all(c in back for c in t)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        ids = {b: i for i, b in self.token.items() if i not in special.values()}
        self.token |= {i: t.encode() for t, i in special.items()}
        self.rank, self.parts = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (b"".join(map(back.__getitem__, x)) for x in (a, b))
            whole = ids[a + b]
            self.rank[ids[a], ids[b]] = (rank, whole)
            self.parts.setdefault(whole, (rank, ids[a], ids[b]))
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            # A token that its own bytes don't merge to can be the last token of no prefix.
            if len(b) == 1 or i in self.parts:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.text = [str(i) for i in range(max(self.token) + 1)]
        self.pattern, self.wide = piece_pattern(0xFFFF), piece_pattern(sys.maxunicode)

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of ``left`` then ``right`` keeps the border between them: undo the
        later of the two tokens' merges, over and over, and see that no merge across the border ranks earlier."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            across = self.rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            down_left, down_right = self.parts.get(left), self.parts.get(right)
            if down_left is None and down_right is None:
                return True
            if down_right is None or down_left is not None and down_left[0] > down_right[0]:
                limit, left = down_left[0], down_left[2]
            elif down_left is None or down_right[0] > down_left[0]:
                limit, right = down_right[0] + 1, down_right[1]
            else:  # the same merge on both sides: the left one is done first
                limit, right = down_right[0] + 1, down_right[1]

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8").decode("latin-1")
        n = len(data)
        size_at, last_at = [0] * (n + 1), [-1] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (size, token) in self.automaton.iter(data):  # by end, and for one end the longest first
            end += 1
            if last_at[end] < 0:
                before = end - size
                if before:
                    left = last_at[before]
                    known = pairs.get(left << 32 | token)
                    if known is None:
                        known = left >= 0 and compatible(left, token)
                    if not known:
                        continue
                last_at[end], size_at[end] = token, size
        ids = []
        while n > 0:
            ids.append(last_at[n])
            n -= size_at[n]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            found = (self.wide if BEYOND.search(part) else self.pattern).findall(part)
            try:
                ids += [*chain.from_iterable(map(self.pieces.__getitem__, found))]
            except KeyError:
                ids += [*chain.from_iterable(map(self.look_up, found))]
        return ids

    def look_up(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.piece(piece)
            if len(piece) <= CACHE_CHARS:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, unless turned off, ``ids`` and ``decoded``.

    One narrow pass: no shuffle, no state beyond the bounded caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
                for text in part.column("text").to_pylist():
                    ids = words.encode(text or "")
                    decoded = words.decode(ids)
                    rows["n_tokens"].append(len(ids))
                    rows["ids_sha256"].append(hashlib.sha256(",".join(map(words.text.__getitem__, ids)).encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_ids:
                        rows["ids"].append(ids)
                        rows["decoded"].append(decoded)
                columns = [part.column("doc_id"), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
