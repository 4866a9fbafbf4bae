"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Every n-gram of a text (lower case, runs of white space as one space, a space at either end) sets one
of ``2**BITS`` hashed features. Over all labelled training rows Spark counts, for each feature, the
rows of either label that hold it. The smoothed log ratio of those counts, of either sign, is drawn towards
zero by ``ERRORS`` of its standard errors, so that chance in rare features says little, and scales the
feature. A logistic regression on the scaled features is fitted on a bounded sample of the training rows.

Defined cases: null and empty texts have the features of a single space and get a score like any
other; labels other than 0 and 1 are ignored; a document labelled twice counts twice; rows without an id have
no label; with labels of one kind, or none, every score is the smoothed share of label 1. Repeated rows get
repeated scores; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.stage import staged, text_hash

BITS = 20
SIZES = (3, 4, 5, 6)
#: The most training rows, and characters in them, of either label that the regression is fitted on; counts use all rows.
SAMPLE_EACH, SAMPLE_CHARS = 2000, 4_000_000
#: Standard errors by which each log ratio is drawn towards zero.
ERRORS = 2.0
#: Rows that smoothing adds to each feature's count.
SMOOTHING = 2.0
THRESHOLD = 0.7
#: The place in the counts that holds the number of rows of either label.
TOTAL = -1

_TIMES = np.random.Generator(np.random.PCG64(99)).integers(0, 2**63, max(SIZES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of one text. ``seen`` is scratch space of ``2**BITS`` places."""
    points = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found, n = [], len(points)
    total = np.zeros(n, np.uint64)
    for size in range(1, max(SIZES) + 1):
        if n < size:
            break
        total = total[: n - size + 1] + points[size - 1 :] * _TIMES[size - 1]
        if size in SIZES:
            found.append(((total + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    if not found:
        return np.zeros(0, np.int64)
    every = np.concatenate(found).astype(np.int64)
    order = np.arange(len(every), dtype=np.int32)
    seen[every] = order
    return every[seen[every] == order]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is in the fold that no label is learnt from (null ids: crc32 of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def feature_counts(rows: DataFrame) -> DataFrame:
    """For each feature the number of rows of either label that hold it (``TOTAL``: that there are): one partial
    row for each task and feature, then one shuffle that is bounded by the number of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, total = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                count[toxic, features(text.as_py(), seen)] += 1
                total[toxic] += 1
        if total.any():
            held = np.flatnonzero(count.any(axis=0))
            columns = [np.append(held, TOTAL), *(np.append(count[y, held], total[y]) for y in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "clean", "toxic"])

    return rows.select("text", "toxic").mapInArrow(run, "feature bigint, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_ratio(clean: Column, toxic: Column, n: list[int]) -> Column:
    """The smoothed log ratio of the shares of rows, drawn towards zero by its standard errors."""
    clean, toxic = (c + SMOOTHING * m / sum(n) for c, m in zip((clean, toxic), n, strict=True))  # in proportion, so that nothing is said of a feature not seen
    ratio = F.log(toxic / n[1]) - F.log(clean / n[0])
    error = F.sqrt(F.greatest(F.lit(0.0), 1 / clean + 1 / toxic - 1 / n[0] - 1 / n[1]))
    return F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - ERRORS * error)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, docs: DataFrame, name: str = "toxicity") -> DataFrame:
        """``docs`` with the score (0 to 1) as ``name``, in place of any such column: one narrow pass."""
        shared = docs.sparkSession.sparkContext.broadcast((self.weight, self.bias))  # 4 * 2**BITS bytes
        docs = docs.drop(name)
        names, schema = docs.columns, StructType([*docs.schema.fields, StructField(name, DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, bias = shared.value
            seen = np.zeros(1 << BITS, np.int32)
            for batch in batches:
                z = np.array([bias + float(weight[features(t.as_py(), seen)].sum(dtype=np.float64)) for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, name])

        return docs.mapInArrow(run, schema)


def fit_weights(columns: np.ndarray, offsets: np.ndarray, labels: np.ndarray, each: np.ndarray, scale: np.ndarray, rounds: int = 150, step: float = 0.05, decay: float = 1e-3, chunk: int = 1 << 19) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by ``scale``, by Adam over the whole bounded sample: row ``i`` holds
    ``columns[offsets[i]:offsets[i + 1]]``. Temporary arrays hold about ``chunk`` features at a time."""
    w, b = np.full(len(scale), 0.1), float(np.log((each @ labels + 1) / (each @ (1 - labels) + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share, sizes = each / each.sum(), np.diff(offsets)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(offsets, np.arange(chunk, offsets[-1] + 1, chunk)), [len(labels)]]))
    for t in range(1, rounds + 1):
        scaled, g, gb = w * scale, np.zeros_like(w), 0.0
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            column, row = columns[offsets[low] : offsets[high]], np.repeat(np.arange(high - low), sizes[low:high])
            z = b + np.bincount(row, scaled[column], high - low)
            error = share[low:high] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[low:high])
            g += np.bincount(column, error[row], len(w))
            gb += error.sum()
        g = g * scale + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * fix * m / (np.sqrt(v) + 1e-9)
        b -= step * fix * mb / (np.sqrt(vb) + 1e-9)
    return w * scale, float(b)


def sampled(docs: DataFrame, marks: DataFrame, most: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The sample that the regression is fitted on: ``doc_id, text_hash, toxic, n`` (rows equal in the three) and the
    text. Rows are chosen by a hash of their key, before any text travels; the chosen keys are at most ``2 * most``."""
    keys = docs.select("doc_id", text_hash().alias("text_hash"), F.length(F.coalesce("text", F.lit(""))).alias("size")).join(marks.hint("merge"), "doc_id")
    keys = keys.groupBy("toxic", "doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    chosen = []
    for y in (0, 1):
        found = keys.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("sample"), "doc_id", "text_hash"), "doc_id", "text_hash").limit(most).collect()
        # A text too long for what is left is passed over, and takes nothing from those after it.
        spent, own = 0, []
        for r in found:
            if spent + r["size"] <= chars:
                spent += r["size"]
                own.append(r)
        chosen += own or sorted(found, key=lambda r: r["size"])[:1]
    picked = staged(docs.sparkSession.createDataFrame([(r["doc_id"], r["text_hash"], r["toxic"], r["n"]) for r in chosen], keys.select("doc_id", "text_hash", "toxic", "n").schema), "toxicity-sample")
    return docs.select("doc_id", text_hash().alias("text_hash"), "text").join(F.broadcast(picked), ["doc_id", "text_hash"])


def train(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the labelled documents given; the caller leaves out what must stay unseen."""
    docs = docs.select("doc_id", "text")
    marks = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # By merge at every size: labels grow with the documents.
    counts = staged(feature_counts(docs.join(marks.hint("merge"), "doc_id")), "toxicity-counts")
    total = counts.filter(F.col("feature") == TOTAL).first()
    n = [0, 0] if total is None else [total["clean"], total["toxic"]]
    weight = np.zeros(1 << BITS, np.float32)
    if not all(n):
        return Model(weight, float(np.log((n[1] + 1) / (n[0] + 1))))
    ratios = counts.filter(F.col("feature") != TOTAL).select(F.col("feature").cast("int"), log_ratio(F.col("clean"), F.col("toxic"), n).alias("ratio"))
    ratios = ratios.filter("ratio != 0").sort("feature").toArrow()  # at most 2**BITS rows of 12 bytes
    at, scale = (ratios.column(c).to_numpy() for c in ("feature", "ratio"))
    place = np.full(1 << BITS, -1, np.int32)
    place[at] = np.arange(len(at))
    places = docs.sparkSession.sparkContext.broadcast(place)  # 4 * 2**BITS bytes

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            found = (places.value[features(t.as_py(), seen)] for t in batch.column("text"))
            lists = pa.array([f[f >= 0] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c) for c in ("doc_id", "text_hash", "toxic", "n"))], names=["found", "doc_id", "text_hash", "toxic", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    sample = sampled(docs, marks, sample_each, sample_chars).mapInArrow(picked, f"found array<int>, doc_id {kind}, text_hash bigint, toxic int, n bigint")
    sample = sample.dropDuplicates(["doc_id", "text_hash", "toxic"]).orderBy("toxic", F.xxhash64("doc_id", "text_hash")).select("found", "toxic", "n").toArrow()
    labels_ = sample.column("toxic").to_numpy().astype(float)
    rows = sample.column("n").to_numpy().astype(float)
    each = rows * np.where(labels_ == 1, n[1] / rows[labels_ == 1].sum(), n[0] / rows[labels_ == 0].sum())
    lists = sample.column("found").combine_chunks()
    del sample
    weights, bias = fit_weights(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]), labels_, each, scale)
    weight[at] = weights
    return Model(weight, bias)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; labels of the held-out fold are not learnt from."""
    learn = docs.filter(~held_out(F.col("doc_id")))
    model = train(learn, labels)
    return model.score(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
