"""Hard-negative mining by exact scores from subset-sum tables (the method of the Four Russians).

Components are integers. A candidate's are cut into bit planes (two's complement), and each plane into bytes of eight
dimensions. For eight dimensions of an anchor a table holds the sums of all 256 subsets of its components. A score is
the sum over planes and bytes of the table's entry at the byte, doubled from plane to plane; the plane of signs counts
negatively. The number of planes follows from the largest component, counted first, so scores are exact.

Rows are dealt into blocks of about ``BLOCK``, anchors into parts of about ``PART``; a block and a part meet in one
group. First each label is dealt on its own, whatever its share of the rows, to find the positives of its anchors.
Then all rows are dealt, to find the first negatives in the band of each positive. Of a block and anchor only the few
first leave a group, as one row; Spark merges them. Scores grow with anchors times rows, as the anchors are a stated
share of the rows; what is shipped is each row once for each part, each anchor once for each block.

Defined cases: rows with a null label or vector, a null or non-finite component, a null id or another number of
components than ``dims`` take no part; rows equal in id, label and vector are one row; a row is no partner of its own
id; equal scores go by smaller id; an anchor without others of its label gives no rows, nor does a positive without a
negative in its band; scores that could exceed 64 bits are an error; empty tables give no rows; other columns are not
read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.stage import staged

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE, DIMS = 256.0, 64
#: Candidates and anchors of a group, and how many of them are scored at a time.
BLOCK, PART = 1 << 14, 1 << 13
TILE, STEP = 1 << 11, 64
PAIRS = "array<struct<score: bigint, id: bigint>>"


def quantised(vectors: DataFrame, label: Column, row: str = "vec_id", vector: str = "embedding", scale: float = SCALE, dims: int = DIMS) -> DataFrame:
    """``id, label, x``: the rows that take part, their components as whole numbers."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(F.col(row).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") == dims) & F.forall("v", fine))
    return rows.select("id", "label", F.transform("v", lambda v: F.floor(v.cast("double") * scale).cast("bigint")).alias("x"))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    found = column.combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), dims)


class Planes:
    """Candidates as bytes of their bit planes: plane, group of eight dimensions, candidate."""

    def __init__(self, x: np.ndarray, planes: int):
        groups = -(-x.shape[1] // 8)
        wide = np.zeros((len(x), groups * 8), np.int64)
        wide[:, : x.shape[1]] = x
        self.n, self.bytes = len(x), np.empty((planes, groups, len(x)), np.uint8)
        for p in range(planes):
            self.bytes[p] = np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little").T

    def scores(self, tables: np.ndarray, first: int, last: int) -> np.ndarray:
        """The scores of the candidates ``first`` to ``last`` with all anchors of ``tables``."""
        total = np.zeros((last - first, tables.shape[2]), tables.dtype)
        looked = np.empty_like(total)
        for p in reversed(range(len(self.bytes))):
            if p < len(self.bytes) - 2:
                total += total
            elif p == len(self.bytes) - 2:
                total *= -2  # what is there are the signs, which count negatively
            for g, table in enumerate(tables):
                np.take(table, self.bytes[p, g, first:last], axis=0, out=looked, mode="clip")
                total += looked
        return total


def tables_of(anchors: np.ndarray, kind: type) -> np.ndarray:
    """The subset sums of each eight dimensions: group, byte, anchor."""
    groups = -(-anchors.shape[1] // 8)
    wide = np.zeros((len(anchors), groups * 8), np.int64)
    wide[:, : anchors.shape[1]] = anchors
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.stack([bits @ wide[:, 8 * g : 8 * g + 8].T for g in range(groups)]).astype(kind)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` first by falling score, then rising id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= floor)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def first_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of each key the ``k`` first of its pairs ``n`` by falling score, then rising id, with their ``rank``. Spark cuts
    to k before and after the shuffle, so no task holds all that the blocks gave."""
    order = Window.partitionBy(*keys).orderBy(F.col("n.score").desc(), "n.id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Each of ``found`` (scores and ids) as one array of pairs."""
    flat = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]).astype(np.int64) for i in (0, 1)]
    return lists([len(x[0]) for x in found], pa.StructArray.from_arrays([pa.array(f) for f in flat], ["score", "id"]))


def met(rows: DataFrame, anchors: DataFrame, keys: list[str], planes: int, dims: int, kind: type, each, schema: str) -> DataFrame:
    """One row for each anchor and block that they share ``keys`` with: ``id, hash`` and what ``each`` makes of the
    anchor's row and its scores with the block's ``id`` and ``label``: a list of scores and ids, or None for no row."""
    deep = schema.count("array") - 1

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, found = [], []
        if len(left) and len(right):
            ids, labels = (left.column(c).to_numpy() for c in ("id", "label"))
            planes_, asked = Planes(matrix(left.column("x"), dims), planes), right.drop_columns(["x"]).to_pylist()
            x = matrix(right.column("x"), dims)
            for at in range(0, len(x), STEP):
                tables = tables_of(x[at : at + STEP], kind)
                scores = np.concatenate([planes_.scores(tables, s, min(s + TILE, planes_.n)) for s in range(0, planes_.n, TILE)])
                for i, own in enumerate(np.ascontiguousarray(scores.T), at):
                    if (got := each(asked[i], own, ids, labels)) is not None:
                        kept.append(i)
                        found.append(got)
        out = lists([len(f) for f in found], pairs([p for f in found for p in f])) if deep else pairs([f[0] for f in found])
        return pa.table({"id": right.column("id").take(pa.array(kept, pa.int64())), "hash": right.column("hash").take(pa.array(kept, pa.int64())), "found": out})

    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(work, f"id bigint, hash bigint, found {schema}")


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, dims: int = DIMS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``rows`` and ``anchors`` hold
    ``id, label, x`` of ``quantised``. Stages and counts the rows, and finds the positives, while the plan is built."""
    rows = staged(rows.distinct(), "negatives-rows")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    n, largest = facts["n"], facts["largest"] or 0
    if dims * largest * largest >= 1 << 62:
        raise ValueError("scores could exceed 64 bits")
    planes, kind = int(largest).bit_length() + 1, np.int32 if dims * largest * largest < 1 << 30 else np.int64
    narrow = "array<smallint>" if largest < 1 << 15 else "array<bigint>"
    rows = rows.withColumn("x", F.col("x").cast(narrow))
    anchors = staged(anchors.distinct().select("id", "label", F.xxhash64("id", "label", "x").alias("hash"), F.col("x").cast(narrow).alias("x")), "negatives-anchors")
    deal = lambda of: F.pmod(F.xxhash64("id", "x"), of).cast("int")

    def first(row: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        other = np.flatnonzero(ids != row["id"])
        top = other[first_of(scores[other], ids[other], positives)]
        return [(scores[top], ids[top])] if len(top) else None

    def banded(row: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        other, out = (labels != row["label"]) & (ids != row["id"]), []
        for p in row["positives"]:
            # Whole scores: the bounds are rounded inwards.
            inside = np.flatnonzero((scores >= -(-low * p["score"] // 100)) & (scores <= high * p["score"] // 100) & other)
            inside = inside[first_of(scores[inside], ids[inside], negatives)]
            out.append((scores[inside], ids[inside]))
        return out if any(len(s) for s, _ in out) else None

    # A label is dealt by its own numbers of rows and anchors.
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = sizes.join(anchors.groupBy("label").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "label")
    own = rows.join(sizes, "label").select("id", "label", "x", deal(F.col("blocks")).alias("block"), upto(F.col("parts")).alias("part"))
    asked = anchors.join(sizes, "label").select("id", "hash", "x", "label", deal(F.col("parts")).alias("part"), upto(F.col("blocks")).alias("block"))
    near = met(own, asked, ["label", "block", "part"], planes, dims, kind, first, PAIRS)
    near = first_rows(near.select("id", "hash", F.explode("found").alias("n")), ["id", "hash"], positives)
    near = staged(near.groupBy("id", "hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda r: r["n"]).alias("positives")), "negatives-positives")

    blocks, parts = (F.lit(max(1, -(-x // size))) for x, size in ((n, block), (anchors.count(), part)))
    all_ = rows.select("id", "label", "x", deal(blocks).alias("block"), upto(parts).alias("part"))
    asked = anchors.join(near, ["id", "hash"]).select("id", "hash", "x", "label", "positives", deal(parts).alias("part"), upto(blocks).alias("block"))
    bands = met(all_, asked, ["block", "part"], planes, dims, kind, banded, f"array<{PAIRS}>").select("id", "hash", F.posexplode("found").alias("at", "band"))
    best = first_rows(bands.select("id", "hash", "at", F.explode("band").alias("n")), ["id", "hash", "at"], negatives)
    best = best.join(near, ["id", "hash"]).withColumn("p", F.get("positives", F.col("at")))
    return best.select(F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
