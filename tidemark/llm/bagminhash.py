"""Near-duplicates by BagMinHash signatures of weighted word shingles, banded, with verified multiset overlap.

A text's multiset holds its runs of five words with their counts. Counts are discretised weights in
dyadic levels (0,1], (1,2], (2,4], ...; each element has one Poisson process on each level, whose points
carry a time, a signature place and a weight within the level. A point counts iff its weight is at most
the element's, so elements of different counts share the points below both, and two signatures agree at
a place with the weighted Jaccard similarity as probability. Signatures of ``BANDS * ROWS`` places are
cut into bands. Links at ``SIMILARITY`` or above, verified on whole multisets, make classes, in two steps:

1. All texts of a bucket are compared with its leader, the one whose buckets are largest in all: of a group
   of copies that is the least changed one, so most of a group becomes one class by one link for each text.
2. Only texts of one bucket in different classes are left. Two texts whose similarity can reach the threshold
   share most elements. Where one of them has too few elements that more than ``RARE`` of the texts left
   hold, they must share rare elements, and are met by these, each of which makes ``RARE**2 / 2`` pairs at
   most. Where both have enough, they are met by bucket and size. Both ways count before they compare, so
   texts of a large group that are all different cost no pairs, and no link between classes is lost.

At similarity 0.8 a pair shares no band with probability (1 - 0.8**5)**30 < 1e-5.

Defined cases: null texts are empty; equal texts are one class whatever their words; a text of one to
four words has one shingle; texts without words have no links to different texts; repeated rows share a
class; null ids get a class like others; the class id is the least id in it; an empty table gives no rows.
Other columns are not read, and ``representatives`` passes them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.stage import small_batches, staged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
#: Texts of different classes that an element is found in, up to which it is rare.
RARE = 16
#: Bytes of texts, and pairs of packed multisets, that a task works on at a time.
SLICE_BYTES, SLICE_PAIRS = 1 << 19, 64
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of the rows of one slice."""
    starts, ends, first = tokens.bounds(data, offsets)
    rolling = tokens.Rolling(tokens.word_hashes(data, starts, ends))
    size = np.diff(first)
    count = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    return row, rolling.span(at, np.minimum(at + SHINGLE, first[1:][row]))


def signatures(row: np.ndarray, element: np.ndarray, rows: int, places: int = BANDS * ROWS) -> np.ndarray:
    """One signature of times for each row (all infinite without elements)."""
    best = np.full((rows, places), np.inf)
    if not len(row):
        return best
    order = np.lexsort((element, row))
    row, element = row[order], element[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (element[1:] != element[:-1])]))
    weight = np.diff(np.append(new, len(row)))
    row, element = row[new], element[new]
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    of = np.repeat(np.arange(len(row)), levels)
    row, limit = row[of], weight[of].astype(float)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    seed = tokens.mix(element[of] + level.astype(np.uint64) * _G)
    time, done, step = np.zeros(len(row)), 0, 1
    flat = best.reshape(-1)
    while len(row):
        j = np.arange(done, done + step, dtype=np.uint64)[None, :] * np.uint64(3)
        draw = lambda k: tokens.mix(seed[:, None] + (j + np.uint64(k)) * _G)  # noqa: E731,B023
        unit = lambda x: ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        times = time[:, None] + np.cumsum(-np.log(unit(draw(1))), axis=1) / (places * width)[:, None]
        place = (draw(2) % np.uint64(places)).astype(np.int64)
        counts = low[:, None] + width[:, None] * unit(draw(3)) <= limit[:, None]
        np.minimum.at(flat, (row[:, None] * places + place)[counts], times[counts])
        time = times[:, -1]
        on = time < best.max(axis=1)[row]
        row, limit, low, width, seed, time = (x[on] for x in (row, limit, low, width, seed, time))
        done, step = done + step, min(step * 2, 32)
    return best


def node() -> Column:
    """A text's key: equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("node")


def banded(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, node, bands`` (no bands for texts without words): one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                found = signatures(*shingles(*tokens.raw(part.column("text"))), part.num_rows)
                bits = tokens.mix(found.view(np.uint64)).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2])
                for i in range(ROWS):
                    key = tokens.mix(key * _G + bits[:, :, i])
                full = np.isfinite(found[:, 0])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(key[full].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", node(), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, bands array<bigint>")


def packed(docs: DataFrame) -> DataFrame:
    """Per row ``node`` and its sorted shingle hashes, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                row, element = shingles(*tokens.raw(part.column("text")))
                element = element[np.lexsort((element, row))]
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                bags = [element[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(bags, pa.binary())], names=["node", "bag"])

    return docs.select("node", "text").mapInArrow(run, "node binary, bag binary")


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    x, y = tag(a), tag(b)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def tag(bag: bytes) -> np.ndarray:
    """Each element's hash mixed with the number of its repeat, so that a multiset becomes a set."""
    x = np.frombuffer(bag, np.uint64)
    first = np.searchsorted(x, x)
    return tokens.mix(x + (np.arange(len(x)) - first).astype(np.uint64) * _G)


def verified(pairs: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, SLICE_PAIRS):
                bags = (batch.column(c).slice(at, SLICE_PAIRS).to_pylist() for c in ("left_bag", "right_bag"))
                keep += [overlap(a, b) >= similarity for a, b in zip(*bags, strict=True)]
            yield batch.select(["left", "right"]).filter(pa.array(keep, pa.bool_()))

    left = bags.select(F.col("node").alias("left"), F.col("bag").alias("left_bag"))
    right = bags.select(F.col("node").alias("right"), F.col("bag").alias("right_bag"))
    return pairs.join(left, "left").join(right, "right").select("left", "right", "left_bag", "right_bag").mapInArrow(run, "left binary, right binary")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every linked node: the least node of its component, by passing least labels along
    links and jumping to the label's own label, each round written so that lineage stays short."""
    both = staged(links.union(links.select("right", "left")).toDF("node", "other"), "near-links")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        moved = staged(least.join(up, "new").select("node", F.col("label").alias("old"), F.least("new", "up").alias("label")), "near-labels")
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels


def buckets(texts: DataFrame) -> DataFrame:
    """``node, band, rank`` of the buckets that hold several texts; ``rank`` orders texts by the sizes of their buckets."""
    keys = staged(texts.select("node", F.explode("bands").alias("band")), "near-keys")
    sizes = keys.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(keys.join(sizes, "band"), "near-shared")
    popular = shared.groupBy("node").agg(F.sum("n").alias("popular"))
    return staged(shared.join(popular, "node").select("node", "band", F.struct("popular", "node").alias("rank")), "near-buckets")


def elements(left: DataFrame, bags: DataFrame) -> DataFrame:
    """``node, label, n, element`` of the texts ``left``: one row for each element of their multisets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = tag(batch.column("bag")[i].as_py())
                take = pa.array(np.full(len(found), i))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(take), batch.column("label").take(take), pa.array(np.full(len(found), len(found))), pa.array(found.view(np.int64))], names=["node", "label", "n", "element"])

    return left.join(bags, "node").select("node", "label", "bag").mapInArrow(run, "node binary, label bigint, n bigint, element bigint")


def between_classes(shared: DataFrame, labels: DataFrame, texts: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """``left, right`` of one bucket and of different classes that can be similar, by counts of their elements."""
    labelled = shared.select("node", "band").join(labels, "node", "left").select("node", "band", F.xxhash64(F.coalesce("label", "node")).alias("label"))
    labelled = staged(labelled, "near-labelled")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("band")
    mixed = staged(labelled.join(mixed, "band"), "near-mixed")
    each = staged(elements(mixed.select("node", "label").distinct(), bags), "near-elements")
    held = each.groupBy("element").agg(F.count("*").alias("texts")).filter("texts > 1")
    found = staged(each.join(held, "element").withColumn("rare", F.col("texts") <= RARE), "near-held")
    # Of two texts of n and m elements at least (n + m) * part are shared.
    part = similarity / (1 + similarity)
    facts = staged(found.groupBy("node", "label", "n").agg(F.count_if(~F.col("rare")).alias("common")), "near-facts")
    alike = (F.col("x.label") != F.col("y.label")) & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9)

    rare = found.filter("rare")
    met = rare.alias("x").join(rare.alias("y"), (F.col("x.element") == F.col("y.element")) & (F.col("x.node") < F.col("y.node")) & alike)
    met = met.groupBy(F.col("x.node").alias("left"), F.col("y.node").alias("right")).agg(F.count("*").alias("shared"))
    met = met.join(facts.select(F.col("node").alias("left"), F.col("n").alias("n1"), F.col("common").alias("c1")), "left")
    met = met.join(facts.select(F.col("node").alias("right"), F.col("n").alias("n2"), F.col("common").alias("c2")), "right")
    met = met.filter(F.col("shared") + F.least("c1", "c2") >= (F.col("n1") + F.col("n2")) * part - 1e-9).select("left", "right")

    # With common elements alone: the largest partner that a text can have.
    able = facts.withColumn("most", F.col("common") / part - F.col("n") + 1e-9).filter(F.col("most") >= similarity * F.col("n") - 1e-9)
    able = able.join(texts, "node").withColumn("step", F.floor(F.log("n") / F.log(F.lit(1 / similarity)) + 1e-9))
    able = staged(mixed.select("node", "band").join(able, "node"), "near-able")
    small, large = able.filter(F.col("most") >= F.col("n")).alias("x"), able.withColumn("step", F.explode(F.array("step", F.col("step") - 1))).alias("y")
    order = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    fits = (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    pairs = small.join(large, (F.col("x.band") == F.col("y.band")) & (F.col("x.step") == F.col("y.step")) & alike & order & fits & once)
    pairs = pairs.select(F.least("x.node", "y.node").alias("left"), F.greatest("x.node", "y.node").alias("right"))
    return met.union(pairs).distinct()


def members(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row ``doc_id, node, label``: rows of one near-duplicate class have one label."""
    with small_batches(docs.sparkSession):
        return labelled(docs, similarity)


def labelled(docs: DataFrame, similarity: float) -> DataFrame:
    rows = staged(banded(docs), "near-rows")
    texts = staged(rows.groupBy("node").agg(F.first("bands").alias("bands")), "near-texts")
    shared = buckets(texts)
    leaders = shared.groupBy("band").agg(F.max("rank").alias("leader")).select("band", F.col("leader.node").alias("leader"))
    found = shared.join(leaders, "band").filter("node != leader")
    pairs = staged(found.select(F.least("node", "leader").alias("left"), F.greatest("node", "leader").alias("right")).distinct(), "near-pairs")
    wanted = shared.select("node").distinct()
    # One row of each wanted text, chosen by its key before any text travels.
    bags = staged(packed(docs.select(node(), "text").join(wanted, "node", "left_semi")).groupBy("node").agg(F.first("bag").alias("bag")), "near-bags")
    edges = staged(verified(pairs, bags, similarity), "near-edges")
    labels = components(edges)
    rest = staged(between_classes(shared, labels, texts, bags, similarity).join(pairs, ["left", "right"], "left_anti"), "near-rest")
    if not rest.isEmpty():
        labels = components(edges.union(staged(verified(rest, bags, similarity), "near-more-edges")))
    return staged(rows.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label")), "near-members")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: ``doc_id, class_id, n_members``."""
    rows = members(docs, similarity)
    sizes = staged(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_members")), "near-classes")
    return rows.join(sizes, "label").select("doc_id", "class_id", "n_members")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: that of the least id (null first), with its own columns."""
    rows = members(docs, similarity).groupBy("label", "doc_id", "node").agg(F.count("*").alias("copies"))
    kept = rows.groupBy("label").agg(F.min(F.struct("doc_id", "node", "copies")).alias("k"))
    kept = staged(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.node").alias("kept_node"), F.col("k.copies").alias("copies")), "near-kept")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), node())
    match = whole["id"].eqNullSafe(kept["kept_id"]) & (whole["node"] == kept["kept_node"])
    once = whole.join(kept.filter("copies = 1"), match, "left_semi")
    again = whole.join(kept.filter("copies > 1"), match, "left_semi").dropDuplicates(["id", "node"])
    return once.unionByName(again).select("row.*")
