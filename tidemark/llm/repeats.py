"""Substring dedup: a compacted de Bruijn graph of word windows, joined by Spark, checked at the source.

Each window of ``WINDOW`` words is an edge. It belongs to its seed, the least-hashed run of ``SEED`` words
within it (the leftmost of equals), so equal windows have equal seeds wherever they stand, and a seed is a
bucket of the graph. Within a bucket consecutive edges of a text form one path, found in one narrow pass: a
row with the path's hash, those of the paths before and after it, and its source coordinates. Paths of a
seed that occurs once are unique and leave the graph. A seed all of whose paths are equal doesn't branch:
its counts of neighbours, joined to its occurrences, tell whether each of them has the same path before it
and after it, and where both sides agree on that the two paths are compacted, across seeds, into one long span. A
branching seed has its paths taken apart into edges, one representative of each path.

Hashes only propose. Spans and edges are read again at their source coordinates, and groups of them hold if
the digests of their words (BLAKE2b, 128 bits) are equal. Seeds of a group that doesn't hold are redone by
comparing the words of all their windows. Groups are counted with partial sums and joined by key, never gathered.

Defined cases: null and empty texts have no words; texts of under ``WINDOW`` words stay whole; windows
that overlap their own repeat count; rows equal in id and text are copies of each other; null ids are
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.stage import keyed, staged

WINDOW, SEED = 35, 12
_SALT = np.uint64(0x9E3779B97F4A7C15)


def seeds(kmers: np.ndarray, reach: int) -> np.ndarray:
    """For each place the leftmost place of the least value among it and the ``reach - 1`` after it."""
    best, have = np.arange(len(kmers)), 1
    while have < reach:
        step = min(have, reach - have)
        best, other = best[: len(best) - step], best[step:]
        best = np.where(kmers[other] < kmers[best], other, best)
        have += step
    return best


class Words:
    """The words of one slice, with their hashes and the first word of each row."""

    def __init__(self, column: pa.Array):
        self.data, offsets = tokens.raw(column)
        self.starts, self.ends, self.first = tokens.bounds(self.data, offsets)
        self.rolling = tokens.Rolling(tokens.word_hashes(self.data, self.starts, self.ends))

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of word runs, by other values than the seeds have."""
        return tokens.mix(self.rolling.span(at, at + size) + _SALT)


def paths(docs: DataFrame, window: int, seed: int, bits: int = 64) -> DataFrame:
    """One row per path: ``doc_id, text_hash, key`` (seed), ``path`` (hash of ``bits`` bits), ``before`` and ``after``
    (parts of its neighbours' hashes, 0 at a text's ends), ``start`` (word) and ``n`` (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                w = Words(part.column("text"))
                count = len(w.starts)
                if count < window:
                    continue
                at = np.arange(count - seed + 1)
                kmers = w.rolling.span(at, at + seed)
                chosen = seeds(kmers, window - seed + 1)
                row = np.searchsorted(w.first, np.arange(len(chosen)), side="right") - 1
                inside = np.arange(len(chosen)) + window <= w.first[row + 1]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1] | (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(begins)
                n = np.diff(np.append(np.cumsum(inside)[start] - 1, inside.sum()))
                path = w.hashes(start, n + window - 1) & np.uint64((1 << bits) - 1)
                short = (path >> np.uint64(32)).astype(np.uint32).view(np.int32) | 1
                same = row[start[1:]] == row[start[:-1]]
                before, after = np.zeros((2, len(start)), np.int32)
                before[1:], after[:-1] = np.where(same, short[:-1], 0), np.where(same, short[1:], 0)
                take = pa.array(row[start])
                columns = [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(kmers[chosen[start]].view(np.int64)), pa.array(path.view(np.int64)), pa.array(before), pa.array(after), pa.array((start - w.first[row[start]]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "key", "path", "before", "after", "start", "n"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, key bigint, path bigint, before int, after int, start int, n int")


#: What a piece of a text is read for: as part of a span of straight seeds, as one of several copies of a branching
#: seed's path, for its single edges, or (seeds that are redone) for the words of its edges.
STRAIGHT, COPY, EDGES, WORDS = range(4)


def at_source(docs: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """Reads ``pieces`` (``doc_id, text_hash, kind, key, path, start, n, left, right, lone``) at their source
    coordinates. Straight pieces that are open to each other are compacted into one span, known by its first seed.
    One row per span, copy or edge: ``doc_id, text_hash, kind, key, path, start, n, lone, high, low`` (the digest of
    its words) and ``words`` (of redone edges)."""
    fields = ["start", "n", "kind", "key", "path", "left", "right", "lone"]
    lists = pieces.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("pieces"))  # at most a text's windows
    right = lists.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                of: list[int] = []
                out: list[list] = [[] for _ in range(7)]
                digests: list[bytes] = []
                for i, (text, found) in enumerate(zip(part.column("text"), part.column("pieces"), strict=True)):
                    words = text.as_py().encode().split()
                    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()
                    line = b" ".join(words)
                    for start, n, kind, key, path, lone in compacted(found.values, window):
                        each = range(start, start + n) if kind in (EDGES, WORDS) else (start,)
                        size = 1 if kind in (EDGES, WORDS) else n
                        for k in each:
                            span = line[ends[k] : ends[k + size + window - 1] - 1]
                            digests.append(hashlib.blake2b(span, digest_size=16).digest())
                            for column, value in zip(out, (kind, key, path, k, size, lone, span if kind == WORDS else None), strict=True):
                                column.append(value)
                            of.append(i)
                take = pa.array(of, pa.int64())
                high, low = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                columns = [part.column("doc_id").take(take), part.column("text_hash").take(take), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), pa.array(high), pa.array(low)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "kind", "key", "path", "start", "n", "lone", "words", "high", "low"])

    both = docs.join(right, docs["doc_id"].eqNullSafe(right["id"]) & (docs["text_hash"] == right["hash"])).select("doc_id", "text_hash", "text", "pieces")
    return both.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, kind int, key bigint, path bigint, start int, n int, lone boolean, words binary, high bigint, low bigint")


def compacted(found: pa.StructArray, window: int) -> list[tuple]:
    """A text's pieces in order as ``(start, n, kind, key, path, lone)``, straight ones that are open to each other as one."""
    out: list[tuple] = []
    opened, end = False, -1  # whether the straight piece before is open to the right, and where it ends
    for start, n, kind, key, path, left, right, lone in zip(*(found.field(i).to_pylist() for i in range(8)), strict=True):
        if kind != STRAIGHT:
            out.append((start, n, kind, key, path, lone))
        elif opened and left and start == end and out[-1][2] == STRAIGHT:
            first = out[-1]
            out[-1] = (first[0], first[1] + n, *first[2:])
            opened, end = right, start + n
        else:
            out.append((start, n, kind, key, 0, lone))
            opened, end = right, start + n
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bits: int = 64) -> DataFrame:
    """Runs of repeated windows per keyed document row: ``doc_id, text_hash, start, n``; adjoining runs stay apart.
    ``bits`` is the width of the paths' hashes; the outcome doesn't depend on it. Runs jobs."""
    found = staged(paths(docs, window, seed, bits), "repeats-paths")
    ends = [f(c).alias(f"{name}_{c}") for c in ("path", "before", "after") for name, f in (("low", F.min), ("high", F.max))]
    keys = found.groupBy("key").agg(F.count("*").alias("total"), *ends).filter("total > 1")
    open_to = lambda c: (F.col(f"low_{c}") == F.col(f"high_{c}")) & (F.col(f"low_{c}") != 0)
    # Written first, so that the join has an exchange on either side and Spark can split a hot seed.
    keys = staged(keys.select("key", (F.col("low_path") == F.col("high_path")).alias("straight"), open_to("before").alias("left"), open_to("after").alias("right")), "repeats-keys")
    hits = staged(found.drop("before", "after").join(keys, "key"), "repeats-hits")
    branching = hits.filter("not straight")
    order = F.xxhash64("doc_id", "text_hash", "start")  # one source for each path
    sources = [F.max_by(c, order).alias(c) for c in ("doc_id", "text_hash", "start", "n")]
    each = staged(branching.groupBy("key", "path").agg(F.count("*").alias("copies"), *sources), "repeats-branches")
    copied = branching.join(each.filter("copies > 1").select("key", "path"), ["key", "path"])
    piece = lambda kind, path="path", left="left", right="right", lone="true": ["doc_id", "text_hash", f"{kind} AS kind", "key", f"{path} AS path", "start", "n", f"{left} AS left", f"{right} AS right", f"{lone} AS lone"]
    pieces = hits.filter("straight").selectExpr(*piece(STRAIGHT, "0L"))
    pieces = pieces.union(copied.selectExpr(*piece(COPY, left="false", right="false"))).union(each.selectExpr(*piece(EDGES, "0L", "false", "false", "copies = 1")))
    read = staged(at_source(docs, pieces, window).drop("words"), "repeats-read")
    whole, edges = read.filter(F.col("kind") != EDGES), read.filter(F.col("kind") == EDGES)
    names = ["doc_id", "text_hash", "start", "n"]
    again = staged(edges.groupBy("key", "high", "low").agg(F.count("*").alias("sources")).filter("sources > 1").drop("sources"), "repeats-again")
    kept = whole.select(names).union(edges.filter("lone").join(again, ["key", "high", "low"]).select(names))
    # Groups of unlike words under one hash, or of spans that weren't compacted alike: as good as never at 64 bits.
    unlike = staged(whole.groupBy("kind", "key", "path").agg(F.count("*").alias("members"), *(f(c).alias(f"{name}_{c}") for c in ("high", "low") for name, f in (("least", F.min), ("most", F.max)))).filter("members < 2 OR least_high <> most_high OR least_low <> most_low").select("kind", "key", "path"), "repeats-unlike")
    if unlike.isEmpty():
        return kept
    doubted = whole.join(unlike, ["kind", "key", "path"])
    spans = doubted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to"))
    redone = staged(hits.join(spans, hits["doc_id"].eqNullSafe(spans["id"]) & (hits["text_hash"] == spans["hash"]) & (hits["start"] >= spans["from"]) & (hits["start"] < spans["to"])).select("key").distinct(), "repeats-doubted")
    # A row given twice is one list of pieces, read for each of its copies, like all others.
    texts = staged(at_source(docs, hits.join(redone, "key").selectExpr(*piece(WORDS, "0L", "false", "false")), window).select(*names, "key", "words"), "repeats-words")
    same = texts.groupBy("key", "words").agg(F.count("*").alias("places")).filter("places > 1").drop("places")
    good = whole.join(unlike, ["kind", "key", "path"], "left_anti").select(names).union(edges.filter("lone").join(again, ["key", "high", "low"]).select(names))
    return good.union(texts.join(same, ["key", "words"]).select(names))


def cut(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True, bits: int = 64) -> DataFrame:
    """Per document row ``doc_id, n_words, n_removed, kept_sha256`` and, unless turned off, the ``kept`` text
    and the removed ``spans`` of words (one-based inclusive pairs)."""
    rows = keyed(docs)
    spans = repeated_spans(rows, window, seed, bits).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    both = rows.join(spans, rows["doc_id"].eqNullSafe(spans["id"]) & (rows["text_hash"] == spans["hash"]), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept", "spans")}
                for text, found in zip(part.column("text"), part.column("spans"), strict=True):
                    words = text.as_py().encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if found.is_valid:
                        start, n = (found.values.field(i).to_numpy() for i in range(2))
                        np.add.at(gone, start, 1)
                        np.add.at(gone, start + n + window - 1, -1)
                    hit = np.cumsum(gone)[:-1] > 0
                    kept = b" ".join([w for w, h in zip(words, hit.tolist(), strict=True) if not h]) if found.is_valid else b" ".join(words)
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(hit.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                        out["kept"].append(kept.decode())
                        out["spans"].append((edge + [1, 0] * (len(edge) // 2)).tolist())
                columns = [part.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
                if with_text:
                    columns += [pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"][: len(columns)])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string"
    return both.mapInArrow(run, schema + (", kept string, spans array<bigint>" if with_text else ""))
