"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period ``q``, no shorter than ``max(LEAST, TIMES * q)``, that no neighbouring
word extends keeping that period. A batch of documents is one array of word numbers, in which no two documents share a
number. Ranks of stretches of 5, 10, 20, ... words are made by doubling; only places whose 5 words occur again in their
document are carried on, as no run has a shorter repeat (``TIMES * q - q`` and ``LEAST - 1`` words at least). They are
sorted into suffix order, and the common words of neighbours (LCP) are added up from the ranks. Neighbours are then
united by decreasing LCP: a union-find class keeps its places as an ordered set, the smaller set is merged into the
larger, and two places that become adjacent by it, no farther apart than the LCP, are the seed of a run. The first
place of a run and the one a period later always become adjacent that way, at an LCP that ends where the run does, so
the seeds that the word before doesn't extend are the runs, each once and with its smallest period.

Documents are never split, and each is worked on within one task: batches hold about ``BATCH`` words, or one document.

Defined cases: null and empty texts have no words and no runs; rows with equal or null ids are worked on separately;
repeated rows each give their row; other columns are not read; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
#: Words of a batch of documents.
BATCH = 1 << 17
#: Places of one part of an ordered set.
LEAF = 10
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class Places:
    """An ordered set of places: bits in parts of 1,024, and the bits of the parts that are there."""

    __slots__ = ("leaves", "top", "n")

    def __init__(self, place: int):
        self.leaves, self.top, self.n = {place >> LEAF: 1 << (place & ((1 << LEAF) - 1))}, 1 << (place >> LEAF), 1

    def __contains__(self, place: int) -> bool:
        return bool(self.leaves.get(place >> LEAF, 0) >> (place & ((1 << LEAF) - 1)) & 1)

    def before(self, place: int) -> int:
        """The greatest place below, or -1."""
        part = place >> LEAF
        if bits := self.leaves.get(part, 0) & ((1 << (place & ((1 << LEAF) - 1))) - 1):
            return (part << LEAF) + bits.bit_length() - 1
        if parts := self.top & ((1 << part) - 1):
            part = parts.bit_length() - 1
            return (part << LEAF) + self.leaves[part].bit_length() - 1
        return -1

    def after(self, place: int) -> int:
        """The least place above, or -1."""
        part, at = place >> LEAF, (place & ((1 << LEAF) - 1)) + 1
        if bits := self.leaves.get(part, 0) >> at:
            return (part << LEAF) + at + (bits & -bits).bit_length() - 1
        if parts := self.top >> (part + 1):
            part += (parts & -parts).bit_length()
            bits = self.leaves[part]
            return (part << LEAF) + (bits & -bits).bit_length() - 1
        return -1

    def __iter__(self) -> Iterator[int]:
        for part in sorted(self.leaves):
            bits, start = self.leaves[part], part << LEAF
            while bits:
                low = bits & -bits
                yield start + low.bit_length() - 1
                bits ^= low

    def take(self, other: Places) -> None:
        for part, bits in other.leaves.items():
            self.leaves[part] = self.leaves.get(part, 0) | bits
        self.top, self.n = self.top | other.top, self.n + other.n


def seeds(edges: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """``(place, period, lcp)`` of the newly adjacent places no farther apart than the LCP that unites them. ``edges``
    are ``(lcp, place, place)`` of neighbours in suffix order, by decreasing LCP."""
    parent: dict[int, int] = {}
    sets: dict[int, Places] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x] = x
            sets[x] = Places(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for lcp, x, y in edges:
        x, y = root(x), root(y)
        large, small = (x, y) if sets[x].n >= sets[y].n else (y, x)
        both, less = sets[large], sets.pop(small)
        parent[small] = large
        both.take(less)
        for place in less:
            left, right = both.before(place), both.after(place)
            if left >= 0 and place - left <= lcp and left not in less:
                yield left, place - left, lcp
            if right >= 0 and right - place <= lcp and right not in less:
                yield place, right - place, lcp


def shifted(ranks: np.ndarray, places: np.ndarray, by: int) -> np.ndarray:
    """The rank ``by`` places on; -1 beyond the end."""
    at = places + by
    return np.where(at < len(ranks), ranks[np.minimum(at, len(ranks) - 1)], -1).astype(np.int64)


def refined(ranks: np.ndarray, live: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks when the ``live`` places are also told apart by the rank ``by`` places on, and the places that still
    aren't alone. A rank is how many places come before those of the same rank, so all others keep theirs."""
    first, second = ranks[live].astype(np.int64), shifted(ranks, live, by)
    order = np.lexsort((second, first))
    first, second, places = first[order], second[order], live[order]
    at = np.arange(len(places))
    opens = np.r_[True, first[1:] != first[:-1]]
    splits = opens | np.r_[True, second[1:] != second[:-1]]
    group, part = np.maximum.accumulate(np.where(opens, at, 0)), np.maximum.accumulate(np.where(splits, at, 0))
    out = ranks.copy()
    out[places] = first + part - group
    alone = splits & np.r_[splits[1:], True]
    return out, np.sort(places[~alone])


def neighbours(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, place, lcp)`` of the neighbours in suffix order that share ``least`` words or more, by decreasing LCP.
    A document ends with a number that occurs nowhere else, so nothing shared goes beyond its end."""
    ranks, live, length = np.zeros(len(words), np.int32), np.arange(len(words)), 1
    order = np.argsort(words, kind="stable")
    opens = np.r_[True, words[order][1:] != words[order][:-1]]
    ranks[order] = np.maximum.accumulate(np.where(opens, np.arange(len(words)), 0))
    live = np.sort(order[~(opens & np.r_[opens[1:], True])])
    while length < least and len(live):
        step = min(length, least - length)
        (ranks, live), length = refined(ranks, live, step), length + step
    repeated, levels = live, [(length, ranks)]
    while len(live):  # until all are told apart
        ranks, live = refined(ranks, live, length)
        length *= 2
        levels.append((length, ranks))
    order = repeated[np.argsort(ranks[repeated], kind="stable")]
    x, y = order[:-1], order[1:]
    same = levels[0][1][x] == levels[0][1][y]
    x, y = x[same], y[same]
    shared = np.zeros(len(x), np.int64)
    for length, ranks in reversed(levels):  # less than twice the length is shared from here
        shared[ranks[x + shared] == ranks[y + shared]] += length
    for _ in range(least - 1):
        shared[words[x + shared] == words[y + shared]] += 1
    down = np.argsort(-shared, kind="stable")
    return x[down], y[down], shared[down]


def runs_of(docs: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each document, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    starts, parts, size = [], [], 0
    for words in docs:
        known: dict[bytes, int] = {}
        starts.append(size)
        # The document's own numbers, then one that ends it.
        parts.append(np.array([known.setdefault(w, size + len(known)) for w in words] + [size + len(words)], np.int64))
        size += len(words) + 1
    if not docs:
        return out
    # What two places a period apart share in the shortest run.
    shortest = min(max(least, times * q) - q for q in range(1, least + 1))
    x, y, lcp = neighbours(np.concatenate(parts), shortest)
    owner = np.searchsorted(starts, x, side="right") - 1
    by_doc = np.argsort(owner, kind="stable")
    x, y, lcp, owner = x[by_doc], y[by_doc], lcp[by_doc], owner[by_doc]
    for d in np.unique(owner).tolist():
        own, base, words = slice(*np.searchsorted(owner, [d, d + 1])), starts[d], docs[d]
        edges = zip(lcp[own].tolist(), (x[own] - base).tolist(), (y[own] - base).tolist(), strict=True)
        for place, period, shared in seeds(edges):
            if shared + period >= max(least, times * period) and (place == 0 or words[place - 1] != words[place + period - 1]):
                out[d].append((place, shared + period, period))
        out[d].sort()
    return out


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def found(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words``, the runs sorted by start, then period, and ``collapsed``: the words that are left when each
    run keeps its first period, joined by single spaces. ``docs`` holds ``doc_id, text``."""
    if least < 2 or times < 2:
        raise ValueError("a run holds its period twice and two words at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # White space of ASCII is what bytes are split at.
            ids, texts, at = batch.column("doc_id"), batch.column("text").cast(pa.binary()), 0
            while at < len(texts):
                docs_, size, first = [], 0, at
                while at < len(texts) and (size < BATCH or at == first):
                    docs_.append((texts[at].as_py() or b"").split())
                    size, at = size + len(docs_[-1]), at + 1
                runs = runs_of(docs_, least, times)
                collapsed = [b" ".join(kept(w, r)) for w, r in zip(docs_, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, at - first), pa.array([len(w) for w in docs_], pa.int64()), pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def looped(docs: DataFrame) -> DataFrame:
    """The query's documents: of one in ten, by a hash of the id, the words from a place on repeat. The hash of a null
    id is null, and its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Looked at several times below, so worked out once.
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    n, g, words = F.size("words"), F.floor(F.col("h") / 10).cast("bigint"), F.col("words")
    split = split.withColumns({"n": n, "a": (g % F.greatest(n, F.lit(1))).cast("int"), "k": 3 + g % 8})
    split = split.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("k"))).cast("int"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return split.select("doc_id", F.when(words.isNotNull() & (n > 0), made).otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """The runs of a document as numbers and digests; the greatest is that of most periods, compared exactly."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    # Runs come sorted, so the first of equals stays.
    top = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    rows = rows.withColumn("top", top)
    t = F.col("top")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), t["start"].alias("start"), t["length"].alias("length"), t["period"].alias("period"),
        F.floor(1000 * t["length"] / t["period"]).cast("bigint").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
