"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are the signs of a vector's components. Distinct codes are dealt by hash into blocks of about ``BLOCK``,
and distinct queries into parts of about ``PART``; each part meets each block in one group of bounded size.
A block is indexed by segments of about log2(its codes) bits, each with its own table of the block's codes.
A query looks up, segment by segment and radius by radius, all codes one of whose segments is at that distance
from its own: after radius ``r`` over all ``m`` segments and ``r + 1`` over the first ``a`` of them, every code
within ``m * (r + 1) + a - 1`` bits has been met. A query ends as soon as its kth verified distance is at most that,
or, when the next radius has more values than the block has codes, by verifying all of the block. Only the ``k + 1``
nearest codes of each query and block leave the group; Spark merges them. Equal codes are one entry of the index with
its ``k + 1`` least ids (no more can be among a query's k nearest), and equal queries are one query.

Defined cases: neighbours are ordered by distance, then id; a row is no neighbour of its own id; null
vectors, vectors of another length than ``bits`` and null ids are neither indexed nor searched for;
fewer than k others give a shorter list; rows equal in id and code count once; null or NaN components
count as not positive; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.stage import staged

K, BITS = 10, 64
#: Codes of a block, and queries of a part: what one group holds, at about 16 bytes each.
BLOCK, PART = 1 << 18, 1 << 16
#: Queries that a task looks up at a time.
STEP = 64


def packed(vector: str, bits: int) -> Column:
    """The code as an array of 64-bit words."""
    positive = lambda i: F.coalesce((F.get(vector, F.lit(i)) > 0) & ~F.isnan(F.get(vector, F.lit(i))), F.lit(False)).cast("bigint")
    word = lambda s: sum((F.shiftleft(positive(s + i), i) for i in range(1, min(64, bits - s))), positive(s))
    return F.array(*[word(s) for s in range(0, bits, 64)])


def codes(vectors: DataFrame, bits: int = BITS, row: str = "vec_id", vector: str = "embedding") -> DataFrame:
    found = vectors.filter(F.col(row).isNotNull() & (F.size(vector) == bits))
    return found.select(F.col(row).alias("id"), packed(vector, bits).alias("code"))


def index_of(rows: DataFrame, k: int) -> DataFrame:
    """``code`` with its ``k + 1`` least ids; the cut is made before and after the shuffle."""
    least = Window.partitionBy("code").orderBy("id")
    return rows.distinct().withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


class Segments:
    """A block's codes by the values of each of their segments."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words = words
        self.width = int(np.clip(round(np.log2(max(len(words), 1))), 4, 16))
        self.parts = [(s, min(self.width, bits - s)) for s in range(0, bits, self.width)]
        self.order, self.starts = [], []
        for s, width in self.parts:
            own = self.of(words, s, width)
            self.order.append(np.argsort(own, kind="stable"))
            self.starts.append(np.searchsorted(own[self.order[-1]], np.arange((1 << width) + 1)))

    @staticmethod
    def of(words: np.ndarray, start: int, width: int) -> np.ndarray:
        value = words[:, start // 64] >> np.uint64(start % 64)
        if start % 64 + width > 64 and start // 64 + 1 < words.shape[1]:
            value = value | words[:, start // 64 + 1] << np.uint64(64 - start % 64)
        return (value & np.uint64((1 << width) - 1)).astype(np.int64)

    def nearest(self, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query its ``k`` nearest codes by distance, then ``ids``: query, place of the code, distance."""
        n, m = len(self.words), len(self.parts)
        kept = [np.zeros(0, np.int64)] * 3  # query, code, distance
        open_ = np.arange(len(queries))
        for radius in range(self.width + 1):
            for a, (s, width) in enumerate(self.parts):
                if not len(open_):
                    return kept[0], kept[1], kept[2]
                masks = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
                if len(masks) * m >= n:  # looking at every code costs less, and covers any distance
                    q, code = np.repeat(open_, n), np.tile(np.arange(n), len(open_))
                    kept = self.best(kept, queries, q, code, ids, k)
                    return kept[0], kept[1], kept[2]
                value = (self.of(queries[open_], s, width)[:, None] ^ masks[None, :]).ravel()
                first, count = self.starts[a][value], self.starts[a][value + 1] - self.starts[a][value]
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                q = np.repeat(np.repeat(open_, len(masks)), count)
                kept = self.best(kept, queries, q, self.order[a][at], ids, k)
                covered = m * radius + a
                full = np.bincount(kept[0][kept[2] <= covered], minlength=len(queries)) >= min(k, n)
                open_ = open_[~full[open_]]
        return kept[0], kept[1], kept[2]

    def best(self, kept: list[np.ndarray], queries: np.ndarray, q: np.ndarray, code: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
        pair = np.unique(np.concatenate([kept[0] * len(self.words) + kept[1], q * len(self.words) + code]))
        q, code = pair // len(self.words), pair % len(self.words)
        distance = np.bitwise_count(queries[q] ^ self.words[code]).sum(axis=1, dtype=np.int64)
        order = np.lexsort((ids[code], distance, q))
        q, code, distance = q[order], code[order], distance[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return [q[place < k], code[place < k], distance[place < k]]


def words_of(column: pa.ChunkedArray, bits: int) -> np.ndarray:
    found = column.combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(found), -(-bits // 64))


def nearest(rows: DataFrame, wanted: DataFrame, k: int = K, bits: int = BITS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``rows`` and ``wanted`` hold ``id, code``, made by ``codes`` with the same ``bits``. Per wanted id ``id, neighbours`` (array of id and distance)."""
    index = staged(index_of(rows, k), "hamming-index")
    asked = staged(wanted.distinct(), "hamming-asked")
    queries = staged(asked.select(F.col("code").alias("query")).distinct(), "hamming-queries")
    blocks, parts = max(1, -(-index.count() // block)), max(1, -(-queries.count() // part))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(F.col("code").alias("word"), F.get("ids", F.lit(0)).alias("least"), F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    right = queries.select("query", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))

    def run(held: pa.Table, sought: pa.Table) -> pa.Table:
        words, q = words_of(held.column("word"), bits), words_of(sought.column("query"), bits)
        ids, out = held.column("least").to_numpy(), []
        if len(words) and len(q):
            found = Segments(words, bits)
            for at in range(0, len(q), STEP):
                i, code, distance = found.nearest(q[at : at + STEP], ids, k + 1)
                out.append(pa.table({"query": sought.column("query").combine_chunks().take(pa.array(i + at)), "code": held.column("word").combine_chunks().take(pa.array(code)), "distance": pa.array(distance.astype(np.int32))}))
        return pa.concat_tables(out) if out else pa.table({"query": pa.array([], pa.list_(pa.int64())), "code": pa.array([], pa.list_(pa.int64())), "distance": pa.array([], pa.int32())})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, "query array<bigint>, code array<bigint>, distance int")
    met = found.join(index, "code").select("query", F.explode("ids").alias("id"), "distance")
    first = Window.partitionBy("query").orderBy("distance", "id")
    # One more than k, as one of the found may be the row itself.
    top = met.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    top = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("best"))
    both = asked.join(top, asked["code"] == top["query"])
    others = F.slice(F.filter("best", lambda n: n["id"] != F.col("id")), 1, k)
    return both.select("id", F.transform(others, lambda n: F.struct(n["id"].alias("id"), n["distance"].alias("distance"))).alias("neighbours"))
